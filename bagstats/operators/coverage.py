"""What a cap kept and dropped: counts per slide and sparse position grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions import spread
from bagstats.functions.spread import beside, lookup, meet, tasks_for
from bagstats.sources.shared import written

KEY = ["slide_id", "patch_idx"]
DEFAULT_STRIDE = 256  # fixed value: stride of a slide whose patches never move


def kept_vs_all(all_patches: DataFrame, kept: DataFrame) -> DataFrame:
    """Every patch with ``kept`` true or false."""
    marks = written(kept.select(*KEY, F.lit(True).alias("kept")), "marks")
    if marks.count() <= spread.BESIDE_ROWS:
        joined = beside(all_patches, marks, KEY, "left", stored=True)
    else:
        joined = meet(all_patches, marks, KEY, "left", tasks_for(all_patches, all_patches.count()))
    return joined.withColumn("kept", F.coalesce("kept", F.lit(False)))


def _shares(counts: DataFrame) -> DataFrame:
    return counts.select(
        "slide_id",
        "n_total",
        "n_kept",
        (F.col("n_total") - F.col("n_kept")).alias("n_discarded"),
        F.round(F.lit(100.0) * F.col("n_kept") / F.col("n_total"), 2).alias("coverage_pct"),
        (F.col("n_kept") < F.col("n_total")).alias("was_capped"),
    )


def coverage_stats(all_patches: DataFrame, kept: DataFrame) -> DataFrame:
    """Per slide: patches in all, kept, discarded, percent kept; two aggregates, no patch join."""
    total = all_patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_total"))
    stored = kept.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return _shares(total.join(stored, "slide_id", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0))))


def coverage_of_index(index: DataFrame) -> DataFrame:
    """The same from the counts of a store's index, without reading a patch."""
    return _shares(index.select("slide_id", F.col("raw_patches").alias("n_total"), F.col("n_patches").alias("n_kept")))


def coverage_overview(coverage: DataFrame) -> DataFrame:
    """Over capped slides: how many, and mean / smallest / median coverage."""
    pct = F.when(F.col("was_capped"), F.col("coverage_pct"))
    return coverage.agg(
        F.count(F.lit(1)).alias("n_slides"),
        F.count(pct).alias("n_capped"),
        F.avg(pct).alias("mean_pct"),
        F.min(pct).alias("min_pct"),
        F.percentile(pct, 0.5).alias("median_pct"),
    )


def worst_coverage(coverage: DataFrame, n: int = 20) -> DataFrame:
    """The n capped slides with the lowest coverage."""
    return coverage.filter("was_capped").orderBy("coverage_pct", "slide_id").limit(n)


def _most_common_step(patches: DataFrame, axis: str) -> DataFrame:
    """Most frequent gap between neighbouring distinct positions; the smallest on ties.

    Positions are made distinct first, so a slide contributes as many rows as it
    has columns (or rows) of patches, not as it has patches.
    """
    positions = patches.select("slide_id", axis).distinct()
    order = Window.partitionBy("slide_id").orderBy(axis)
    steps = positions.select("slide_id", (F.col(axis) - F.lag(axis).over(order)).alias("step")).dropna()
    counts = steps.groupBy("slide_id", "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("slide_id").agg(F.min_by("step", F.struct(-F.col("n"), "step")).alias(f"step_{axis}"))


def infer_patch_stride(patches: DataFrame) -> DataFrame:
    """Stride of every slide: from x, else from y, else a fixed default."""
    slides = patches.select("slide_id").distinct()
    steps = slides.join(_most_common_step(patches, "x"), "slide_id", "left")
    steps = steps.join(_most_common_step(patches, "y"), "slide_id", "left")
    return steps.select("slide_id", F.coalesce("step_x", "step_y", F.lit(DEFAULT_STRIDE)).cast("int").alias("stride"))


def coverage_grid(all_patches: DataFrame, kept: DataFrame | None = None, stride: int | None = None) -> DataFrame:
    """Occupied grid cells: state 2 when any patch is kept, 1 when all are discarded."""
    corner = all_patches.groupBy("slide_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"))
    if stride is None:
        corner = corner.join(infer_patch_stride(all_patches), "slide_id")
    else:
        corner = corner.withColumn("stride", F.lit(stride))
    if kept is None:
        marked = all_patches.select(*KEY, "x", "y", F.lit(2).alias("state"))
    else:
        flags = kept_vs_all(all_patches.select(*KEY, "x", "y"), kept)
        marked = flags.select(*KEY, "x", "y", F.when(F.col("kept"), 2).otherwise(1).alias("state"))
    placed = lookup(marked, corner, ["slide_id"], ["patch_idx"])
    cells = placed.select(
        "slide_id",
        F.floor((F.col("x") - F.col("min_x")) / F.col("stride")).cast("int").alias("gx"),
        F.floor((F.col("y") - F.col("min_y")) / F.col("stride")).cast("int").alias("gy"),
        "state",
    )
    return cells.groupBy("slide_id", "gx", "gy").agg(F.max("state").alias("state"))
