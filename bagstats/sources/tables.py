"""Manifests, split tables, predictions, embeddings, reports and slide lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstats.functions.ids import normalize_slide_id
from bagstats.functions.probs import prob_columns
from bagstats.operators.manifest import ORDINAL, prepare_manifest, require_columns
from bagstats.operators.quality import order_free_fingerprint

SCHEMA_VERSION = 1


# --- manifests --------------------------------------------------------------


def read_csv_in_order(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV rows as text with ``row_ordinal``, which orders them as they stand: by file, block of the file, and row in it.

    The number of a row grows inside one task and a block is read by one task, so it orders the rows of a block whatever
    else the task reads.  A quoted value may hold line breaks; without ``multi_line`` it may not, and large files are cut into blocks.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select("*", place.alias(ORDINAL))


def read_manifest(
    spark: SparkSession,
    path: str,
    filename_col: str = "filename",
    label_col: str = "label",
    group_col: str | None = None,
    site_col: str | None = None,
    order_col: str | None = None,
    multi_line: bool = True,
    keep_order: bool = False,
) -> DataFrame:
    """CSV manifest as a typed slide table; all columns are text, extras pass through.

    Of rows of one slide the first in the file stays, or the first by ``order_col``.  ``keep_order`` keeps ``row_ordinal``.
    """
    raw = read_csv_in_order(spark, path, multi_line)
    require_columns(raw, Filename=filename_col, Label=label_col)
    out = prepare_manifest(raw, filename_col, label_col, group_col, order_col or ORDINAL)
    if site_col and site_col in out.columns and site_col != "site":
        out = out.withColumnRenamed(site_col, "site")
    return out if keep_order else out.drop(ORDINAL)


def read_slide_list(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Wanted slides from a text file, one per line; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.select(normalize_slide_id("line", root).alias("slide_id")).distinct()


def list_slides(spark: SparkSession, root: str, extensions: Sequence[str], nested: bool = False) -> DataFrame:
    """Slides found below a folder by file extension; only names are read, never contents."""
    endings = [e.lower() for e in extensions]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower())
    paths = reader.load(root).select(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/").alias("path"))
    matching = paths.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(endings))
    return matching.select(normalize_slide_id("path", root).alias("slide_id")).distinct()


# --- tables with an identity ------------------------------------------------


def _write_identity(df: DataFrame, path: str, **texts: str) -> None:
    row = df.select(F.col("fingerprint"), *[F.lit(v).alias(k) for k, v in texts.items()])
    row.withColumn("schema_version", F.lit(SCHEMA_VERSION)).coalesce(1).write.mode("overwrite").json(path)


def integrity_fingerprint(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """One hash over the contents of a manifest and of the splits made from it."""
    left = order_free_fingerprint(manifest, sorted(manifest.columns), 64).withColumnRenamed("fingerprint", "m")
    right = order_free_fingerprint(splits, sorted(splits.columns), 64).select("fingerprint")
    both = left.withColumn("s", right.scalar())
    return both.select(F.sha2(F.concat_ws("|", "m", "s"), 256).alias("fingerprint"))


def write_splits(splits: DataFrame, path: str, manifest: DataFrame, identity: str, overwrite: bool = False) -> None:
    """Splits first, their identity row last: a reader that finds the row finds whole data."""
    mode = "overwrite" if overwrite else "errorifexists"
    splits.write.mode(mode).parquet(f"{path}/data")
    stored = splits.sparkSession.read.parquet(f"{path}/data")
    _write_identity(integrity_fingerprint(manifest, stored), f"{path}/identity", identity=identity)


def verify_integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Stored against recomputed fingerprint, both as prefixes, and whether they agree."""
    stored = spark.read.json(f"{path}/identity").select(F.col("fingerprint").alias("stored"))
    now = integrity_fingerprint(manifest, spark.read.parquet(f"{path}/data"))
    both = stored.withColumn("current", now.scalar())
    return both.select(
        F.substring("stored", 1, 16).alias("stored"),
        F.substring("current", 1, 16).alias("current"),
        (F.col("stored") == F.col("current")).alias("intact"),
    )


def verify_identity(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """Whether stored output was made by the same settings (canonical JSON text)."""
    stored = spark.read.json(f"{path}/identity").select("identity")
    wanted = F.sha2(F.lit(identity), 256)
    return stored.select(
        F.substring(F.sha2("identity", 256), 1, 16).alias("stored"),
        F.substring(wanted, 1, 16).alias("requested"),
        (F.col("identity") == F.lit(identity)).alias("same"),
    )


class IntegrityError(Exception):
    """Stored output does not belong to the given manifest or settings."""


def read_splits(
    spark: SparkSession, path: str, manifest: DataFrame | None = None, identity: str | None = None
) -> DataFrame:
    """Stored splits; with a manifest or settings the identity row is checked first (one row is fetched)."""
    checks = []
    if identity is not None:
        checks.append(("same", "settings", verify_identity(spark, path, identity)))
    if manifest is not None:
        checks.append(("intact", "contents", verify_integrity(spark, path, manifest)))
    for flag, what, report in checks:
        row = report.first()
        if row is None or not row[flag]:
            raise IntegrityError(f"Stored splits at {path} do not match the {what}: {row}")
    return spark.read.parquet(f"{path}/data")


# --- predictions and embeddings ---------------------------------------------


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction table, one folder per fold when there is a fold column."""
    writer = df.write.mode("errorifexists")
    if "fold" in df.columns:
        writer = writer.partitionBy("fold")
    writer.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with the probability columns in numeric order at the end."""
    df = spark.read.parquet(path)
    probs = prob_columns(df)
    return df.select(*[c for c in df.columns if c not in probs], *probs)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Slide vectors keyed by slide."""
    df.select("slide_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("errorifexists").parquet(path)


# --- reports ----------------------------------------------------------------


def finite_or_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN and infinities replaced by null."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            value = F.col(name)
            out.append(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; values JSON has no word for become null and stay as explicit nulls."""
    finite_or_null(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_coverage_stats(coverage: DataFrame, path: str) -> None:
    coverage.write.mode("errorifexists").option("header", True).csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("errorifexists").option("header", True).csv(path)
