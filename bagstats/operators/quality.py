"""Data-quality checks: each is a table of violations or counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.probs import prob_columns
from bagstats.functions.spread import tasks_for
from bagstats.operators.manifest import found_and_expected
from bagstats.sources.shared import written

STRETCH = 4096  # patch numbers of a slide that one task judges together
# Spark's names for a table without hidden file columns.
NO_FILES = ("UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION", "FIELD_NOT_FOUND")
# Reasons a slide is rejected, first failing one wins.
REJECT_NO_FEATURES = "features missing"
REJECT_NO_COORDS = "coords missing"
REJECT_MIXED_DIM = "feature dimension differs inside the slide"
REJECT_EMPTY_DIM = "invalid feature dimension"
REJECT_MISMATCH = "patch count mismatch between features and coords"
REJECT_DUPLICATE = "duplicate patch index"
REJECT_FOREIGN_DIM = "feature dimension differs from the other slides"


def bag_facts(patches: DataFrame, rows: int | None = None) -> DataFrame:
    """Per slide: patches, rows with features, rows with coordinates, dimensions, index range.

    A slide is dealt by stretches of patch numbers, in which copies meet, and leaves a stretch as one row.
    ``rows`` is the number of patches, if it is known.
    """
    has_xy = F.col("x").isNotNull() & F.col("y").isNotNull()
    stretch = F.floor(F.col("patch_idx") / F.lit(STRETCH))
    facts = patches.select(
        "slide_id", "patch_idx", stretch.alias("stretch"), F.col("features").isNotNull().alias("has_features"), has_xy.alias("has_xy"), F.size("features").alias("dim")
    )
    tasks = [tasks_for(patches, rows)] if rows is not None else []
    per_patch = facts.repartition(*tasks, "slide_id", "stretch").groupBy("slide_id", "stretch", "patch_idx").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if("has_features").alias("n_features"),
        F.count_if("has_xy").alias("n_coords"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
    )
    return per_patch.groupBy("slide_id").agg(
        F.sum("copies").alias("n_patches"),
        F.sum("n_features").alias("n_features"),
        F.sum("n_coords").alias("n_coords"),
        F.min("min_dim").alias("min_dim"),
        F.max("max_dim").alias("max_dim"),
        F.max("copies").alias("copies"),
    )


def judge_bags(patches: DataFrame, feat_dim: int | None = None, rows: int | None = None) -> DataFrame:
    """Facts of every slide with the first ``reason`` to reject it (null when it is valid).

    The expected dimension is given or is the most common one (the smallest on ties).
    """
    # Written once: the expected dimension and the reasons come out of one pass over the patches.
    facts = written(bag_facts(patches, rows), "facts")
    usual = F.lit(feat_dim) if feat_dim else facts.agg(F.mode("max_dim", True)).scalar()
    reason = (
        F.when(F.col("n_features") == 0, REJECT_NO_FEATURES)
        .when(F.col("n_coords") == 0, REJECT_NO_COORDS)
        .when(F.col("n_features") != F.col("n_coords"), REJECT_MISMATCH)
        .when(F.col("min_dim") != F.col("max_dim"), REJECT_MIXED_DIM)
        .when(F.col("max_dim") <= 0, REJECT_EMPTY_DIM)
        .when(F.col("copies") > 1, REJECT_DUPLICATE)
        .when(F.col("max_dim") != usual, REJECT_FOREIGN_DIM)
    )
    return facts.withColumn("reason", reason)


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the valid slides, and ``slide_id, n_patches, reason`` of the rejected ones."""
    valid = judged.filter(F.col("reason").isNull()).select("slide_id", "n_patches", F.col("max_dim").alias("feat_dim"))
    return valid, judged.filter(F.col("reason").isNotNull()).select("slide_id", "n_patches", "reason")


def validate_bags(patches: DataFrame, feat_dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected slides of a patch table."""
    return split_judged(judge_bags(patches, feat_dim))


def range_gaps(index: DataFrame) -> DataFrame:
    """Rows whose range does not start where the previous one of the shard ended.

    The first range of a shard must start at zero.  Shards are size-limited, so a
    window over one shard is bounded.
    """
    order = Window.partitionBy("shard").orderBy("start_row", "slide_id")
    end = F.col("start_row") + F.col("n_patches")
    rows = index.select(
        "shard", "slide_id", "start_row", F.coalesce(F.lag(end).over(order), F.lit(0)).alias("expected_start")
    )
    wrong = rows.filter(F.col("start_row") != F.col("expected_start"))
    kind = F.when(F.col("start_row") > F.col("expected_start"), "gap").otherwise("overlap")
    return wrong.withColumn("problem", kind)


def validate_bag_index(index: DataFrame, patches: DataFrame, n_shards: int | None = None) -> DataFrame:
    """All violations of an index table against its patch table: ``slide_id, rule``."""
    problems = [
        index.groupBy("slide_id").count().filter("count > 1").select("slide_id", F.lit("duplicate id").alias("rule")),
        index.filter("n_patches <= 0").select("slide_id", F.lit("count not positive").alias("rule")),
        index.filter("raw_patches < n_patches").select("slide_id", F.lit("raw count below stored").alias("rule")),
        range_gaps(index).select("slide_id", F.concat(F.lit("range "), F.col("problem")).alias("rule")),
    ]
    if n_shards is not None:
        outside = index.filter((F.col("shard") < 0) | (F.col("shard") >= n_shards))
        problems.append(outside.select("slide_id", F.lit("shard out of range").alias("rule")))
    stored = patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("stored"))
    both = index.select("slide_id", "n_patches").join(stored, "slide_id", "full")
    differs = ~F.col("n_patches").eqNullSafe(F.col("stored"))
    problems.append(both.filter(differs).select("slide_id", F.lit("count differs from patches").alias("rule")))
    out = problems[0]
    for other in problems[1:]:
        out = out.unionByName(other)
    return out


def not_empty(df: DataFrame) -> DataFrame:
    """One row telling whether the table has rows (stops at the first one)."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("not_empty"))


def no_nans(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and null counts per column, by default of the probability columns."""
    names = list(cols) if cols is not None else prob_columns(df)
    if not names:
        raise ValueError(f"No columns to check. Available: {df.columns}")
    pairs = []
    for name in names:
        number = F.col(name).cast("double")
        pairs += [
            F.count_if(F.isnan(number)).alias(f"nan__{name}"),
            F.count_if(number.isNull()).alias(f"null__{name}"),
        ]
    row = df.agg(*pairs)
    entries = [
        F.struct(F.lit(n).alias("column"), F.col(f"nan__{n}").alias("n_nan"), F.col(f"null__{n}").alias("n_null"))
        for n in names
    ]
    return row.select(F.inline(F.array(*entries)))


def completeness(expected: DataFrame, found: DataFrame, require_all: bool = True) -> DataFrame:
    """Total, found and missing slides and whether that is acceptable."""
    report = found_and_expected(expected, found)
    return report.withColumn("complete", (F.col("missing") == 0) | F.lit(not require_all))


def subgroup_counts(preds: DataFrame, by: Sequence[str] = (), patient_col: str = "patient_id") -> DataFrame:
    """Rows, slides, patients (and folds) of a prediction table."""
    aggregates = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("slide_id").alias("n_slides"),
        F.count_distinct(patient_col).alias("n_patients"),
    ]
    if "fold" in preds.columns and "fold" not in by:
        aggregates.append(F.count_distinct("fold").alias("n_folds"))
    return preds.groupBy(*by).agg(*aggregates)


# --- fingerprints -----------------------------------------------------------

_LANES = 4  # digests are added in four 60-bit lanes


def _row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the row; nulls and separators cannot be confused with text."""
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def order_free_fingerprint(df: DataFrame, cols: Sequence[str] | None = None, length: int = 12) -> DataFrame:
    """Hash of the multiset of rows: the same for any order or partitioning.

    Row digests are added lane by lane (an aggregate that combines before the
    shuffle), so nothing is sorted or gathered.  An empty table gives ``empty``.
    """
    names = list(cols) if cols is not None else df.columns
    lanes = df.select(_row_digest(names).alias("d")).select(
        *[F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"l{i}") for i in range(_LANES)]
    )
    sums = lanes.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(_LANES)])
    header = ",".join(names)
    text = F.concat_ws("|", F.lit(header), F.col("n"), *[F.col(f"s{i}").cast("string") for i in range(_LANES)])
    digest = F.substring(F.sha2(text, 256), 1, length)
    return sums.select(F.when(F.col("n") == 0, F.lit("empty")).otherwise(digest).alias("fingerprint"))


def source_fingerprint(index: DataFrame, settings: dict[str, object], length: int = 20) -> DataFrame:
    """Hash of the facts of every slide together with the build settings."""
    text = ";".join(f"{k}={settings[k]}" for k in sorted(settings))
    facts = [c for c in ("slide_id", "n_patches", "raw_patches", "feat_dim", "coord_dim") if c in index.columns]
    rows = order_free_fingerprint(index, facts, 64)
    mixed = F.sha2(F.concat_ws("|", F.col("fingerprint"), F.lit(text)), 256)
    return rows.select(F.substring(mixed, 1, length).alias("fingerprint"))


def source_identity(files: DataFrame, settings: dict[str, object], length: int = 20) -> DataFrame:
    """Hash of the files a table is read from (name, size, time of change) together with the build settings.

    The facts come from Spark's hidden file columns, so no column of the table is read, and a file that was written anew
    changes the mark whatever it holds.  A table that is not read from files is hashed row by row.
    """
    text = ";".join(f"{k}={settings[k]}" for k in sorted(settings))
    try:
        facts = files.select(*[F.col(f"_metadata.{c}") for c in ("file_path", "file_name", "file_size", "file_modification_time")]).distinct()
        rows = order_free_fingerprint(
            facts.withColumn("file_modification_time", F.unix_micros("file_modification_time")), ["file_name", "file_size", "file_modification_time"], 64
        )
    except AnalysisException as missing:
        if missing.getCondition() not in NO_FILES:
            raise
        rows = order_free_fingerprint(files, None, 64)
    mixed = F.sha2(F.concat_ws("|", F.col("fingerprint"), F.lit(text)), 256)
    return rows.select(F.substring(mixed, 1, length).alias("fingerprint"))
