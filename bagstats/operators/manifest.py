"""Manifest preparation: one row per slide with a group, a label and optional extras."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstats.functions.ids import normalize_slide_id
from bagstats.functions.spread import lookup


ORDINAL = "row_ordinal"  # the place of a row in its file, see ``read_csv_in_order``


def require_columns(df: DataFrame, **needed: str) -> None:
    """Fail at once, naming what is missing and what there is."""
    for role, name in needed.items():
        if name not in df.columns:
            raise ValueError(f"{role} column '{name}' not found. Available: {df.columns}")


def derive_group(df: DataFrame, group_col: str | None = None) -> DataFrame:
    """Add ``group_id``: the group column as text; rows without one form their own group."""
    if group_col is None or group_col not in df.columns:
        return df.withColumn("group_id", F.col("slide_id"))
    return df.withColumn("group_id", F.coalesce(F.col(group_col).cast("string"), F.col("slide_id")))


def drop_unlabelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Drop rows without a label and make the label text."""
    return df.dropna(subset=[label_col]).withColumn(label_col, F.col(label_col).cast("string"))


def dedup_slides(df: DataFrame, order_col: str, id_col: str = "slide_id") -> tuple[DataFrame, DataFrame]:
    """First row of every id in ``order_col`` order, and the number of rows dropped; ties go to the smallest row.

    The survivor is found with an aggregate that combines before the shuffle, so an
    id repeated very often does not fill one task.
    """
    rows = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(id_col).agg(F.min_by(rows, F.struct(F.col(order_col), rows)).alias("__row"))
    first = kept.select("__row.*")
    counts = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    dropped = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_dropped"))
    return first, dropped


def prepare_manifest(
    df: DataFrame,
    filename_col: str,
    label_col: str,
    group_col: str | None = None,
    order_col: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Raw manifest rows to ``slide_id, group_id, filename, label`` plus all other columns.

    Of rows of one slide the first by ``order_col`` stays (by default by their place in the file where that is known, else by file name).
    """
    require_columns(df, Filename=filename_col, Label=label_col)
    with_id = df.withColumn("slide_id", normalize_slide_id(filename_col, root))
    first, _ = dedup_slides(with_id, order_col or (ORDINAL if ORDINAL in df.columns else filename_col))
    grouped = derive_group(first, group_col)
    named = grouped
    for old, new in ((filename_col, "filename"), (label_col, "label")):
        if old != new:
            named = named.withColumnRenamed(old, new)
    return drop_unlabelled(named)


def filter_rule(df: DataFrame, rule: str, flag: str = "matched") -> DataFrame:
    """Mark the rows that satisfy a SQL predicate; a null counts as no match."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "", rule)  # quoted text may hold any sign
    if "&" in bare or "|" in bare.replace("||", ""):
        raise ValueError(f"Use 'and' / 'or' instead of '&' / '|' in the rule: {rule!r}")
    try:
        kind = df.select(F.expr(rule)).dtypes[0][1]
    except Exception as exc:
        raise ValueError(f"Failed to evaluate rule {rule!r}: {exc}") from exc
    if kind != "boolean":
        raise ValueError(f"Rule {rule!r} is not a predicate but has type {kind}")
    return df.withColumn(flag, F.coalesce(F.expr(rule), F.lit(False)))


def restrict_to_manifest(
    df: DataFrame, manifest: DataFrame, id_col: str = "slide_id", filename_col: str = "filename"
) -> DataFrame:
    """Keep rows whose slide is listed; ids come from ``id_col`` or, without it, from file names.

    A null or empty id in the manifest fails the job when it runs.
    """
    if id_col in manifest.columns:
        source = F.col(id_col).cast("string")
    elif filename_col in manifest.columns:
        source = F.col(filename_col).cast("string")
    else:
        raise ValueError(f"Neither '{id_col}' nor '{filename_col}' found. Available: {manifest.columns}")
    listed = manifest.select(source.alias("__raw")).distinct()
    bad = F.col("__raw").isNull() | (F.trim("__raw") == "")
    failure = F.raise_error(F.lit("manifest holds a null or empty slide id")).cast("string")
    wanted = listed.select(F.when(bad, failure).otherwise(normalize_slide_id("__raw")).alias("slide_id"))
    return df.join(wanted, "slide_id", "left_semi")


def _last_per_slide(manifest: DataFrame, value_col: str, order_col: str | None) -> DataFrame:
    """The last value of every slide: by ``order_col``, else by place in the file, else the largest; a last row without value gives null."""
    order_col = order_col or (ORDINAL if ORDINAL in manifest.columns else None)
    value = F.struct(F.col(value_col))
    last = F.max_by(value, F.struct(F.col(order_col), value)) if order_col else F.max(value)
    return manifest.groupBy("slide_id").agg(last[value_col].alias(value_col))


def attach_patient(
    preds: DataFrame, manifest: DataFrame | None, patient_col: str = "patient_id", order_col: str | None = None
) -> DataFrame:
    """Add the patient of every slide: that of its last manifest row (see ``_last_per_slide``), or else the slide id."""
    if patient_col in preds.columns:
        return preds
    own = F.col("slide_id").cast("string")
    if manifest is None or patient_col not in manifest.columns:
        return preds.withColumn(patient_col, own)
    mapping = _last_per_slide(manifest, patient_col, order_col)
    joined = preds.join(mapping, "slide_id", "left")
    return joined.withColumn(patient_col, F.coalesce(F.col(patient_col).cast("string"), own))


def attach_labels(df: DataFrame, manifest: DataFrame, label_col: str = "label", order_col: str | None = None) -> DataFrame:
    """Add the integer label of every slide: that of its last manifest row, null when there is none."""
    mapping = _last_per_slide(manifest, label_col, order_col)
    typed = mapping.withColumn(label_col, F.col(label_col).cast("int"))
    spread = [c for c in df.columns if c != "slide_id"] or ["slide_id"]
    return lookup(df, typed, ["slide_id"], spread, how="left")


def label_or_default(slides: DataFrame, labels: DataFrame, default: int = -1) -> DataFrame:
    """Label of every slide, ``default`` when it has none."""
    joined = slides.join(labels.select("slide_id", "label"), "slide_id", "left")
    return joined.withColumn("label", F.coalesce(F.col("label").cast("int"), F.lit(default)))


def missing_features(manifest: DataFrame, patches_or_index: DataFrame) -> DataFrame:
    """Manifest slides that have no stored features."""
    have = patches_or_index.select("slide_id").distinct()
    return manifest.select("slide_id").distinct().join(have, "slide_id", "left_anti")


def pending_slides(wanted: DataFrame, done: DataFrame, fingerprint: str | Column) -> DataFrame:
    """Wanted slides not yet done under this encoder fingerprint (all of them after a change)."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    finished = done.filter(F.col("fingerprint") == mark).select("slide_id").distinct()
    return wanted.select("slide_id").distinct().join(finished, "slide_id", "left_anti")


def label_distribution(df: DataFrame, by: Sequence[str] = (), label_col: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))


def group_majority_label(df: DataFrame) -> DataFrame:
    """Most frequent label of every group; the smallest wins a tie."""
    return df.groupBy("group_id").agg(F.mode("label", True).alias("label"))


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    """One row with the number of distinct values of each named column."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(name) for name, c in columns.items()])


def num_classes(df: DataFrame) -> DataFrame:
    return distinct_counts(df, n_classes="label")


def num_groups(df: DataFrame) -> DataFrame:
    return distinct_counts(df, n_groups="group_id")


def sorted_slides(df: DataFrame) -> DataFrame:
    """Rows in slide order (a range-partitioned, distributed sort)."""
    return df.orderBy("slide_id")


def first_n_examples(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct values of a column, for messages."""
    return df.select(col).distinct().orderBy(col).limit(n)


def argmax_with_ties(
    df: DataFrame, objective: Column, order: Sequence[Column], by: Sequence[str] = ()
) -> DataFrame:
    """Best row of every group; on equal objectives the row with the smallest ``order`` values."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*by).agg(F.min_by(row, F.struct((-objective).alias("o"), *order)).alias("__row"))
    return best.select("__row.*")


def expected_minus_found(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct expected rows that were not found."""
    return expected.subtract(found)


def found_and_expected(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Total, found and missing slides in one pass over both lists."""
    marked = expected.select("slide_id", F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(
        found.select("slide_id", F.lit(0).alias("e"), F.lit(1).alias("f"))
    )
    per_slide = marked.groupBy("slide_id").agg(F.max("e").alias("e"), F.max("f").alias("f"))
    return per_slide.agg(
        F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum(F.col("e") * F.col("f")), F.lit(0)).cast("bigint").alias("found"),
        F.coalesce(F.sum(F.col("e") * (1 - F.col("f"))), F.lit(0)).cast("bigint").alias("missing"),
    )
