"""Pooling patches to one vector per slide.

Vector sums use the JVM vector summarizer: it combines on the map side, so a huge
slide becomes one partial vector per task and no bag is ever held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.spread import lookup

_BAND = 64.0  # logits are summed in bands of this width, so exp() can neither overflow nor vanish


def _vector(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def pool_mean(patches: DataFrame) -> DataFrame:
    """Mean feature vector per slide."""
    pooled = patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_patches"), Summarizer.mean(_vector("features")).alias("v")
    )
    return pooled.select("slide_id", "n_patches", vector_to_array("v").alias("embedding"))


def pool_max(patches: DataFrame) -> DataFrame:
    """Largest value of every feature per slide."""
    pooled = patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_patches"), Summarizer.max(_vector("features")).alias("v")
    )
    return pooled.select("slide_id", "n_patches", vector_to_array("v").alias("embedding"))


def _band(logit: Column) -> Column:
    return F.floor(logit / F.lit(_BAND))


def _in_band(logit: Column) -> Column:
    """exp(logit) relative to the top of its band: between exp(-64) and 1."""
    return F.exp(logit - (_band(logit) + 1) * F.lit(_BAND))


def _to_top_band(by: Sequence[str] = ("slide_id",)) -> Column:
    """Factor that brings a band's sums to the group's highest band (a handful of bands per group)."""
    top = F.max("band").over(Window.partitionBy(*by))
    return F.exp((F.col("band") - top) * F.lit(_BAND))


def attention_pool(
    patches: DataFrame, logit: str = "logit", features: str = "features", by: Sequence[str] = ("slide_id",)
) -> DataFrame:
    """Softmax-weighted mean of the patch vectors per slide.

    A weighted mean is kept per (slide, band of logits) and the few bands of a slide
    are averaged with rescaled weights, so the maximum is not needed first and the
    wide column is not shuffled.  Means, not sums, keep all numbers at feature scale.
    """
    rows = patches.select(
        *by, _band(F.col(logit)).alias("band"), _in_band(F.col(logit)).alias("w"), _vector(features).alias("v")
    )
    bands = rows.groupBy(*by, "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), Summarizer.mean(F.col("v"), F.col("w")).alias("v")
    )
    scaled = bands.withColumn("w", F.col("w") * _to_top_band(by))
    pooled = scaled.groupBy(*by).agg(
        F.sum("n").alias("n_patches"), Summarizer.mean(F.col("v"), F.col("w")).alias("v")
    )
    return pooled.select(*by, "n_patches", vector_to_array("v").alias("embedding"))


def bag_softmax(df: DataFrame, logit_col: str = "logit") -> DataFrame:
    """Add ``attention``: the softmax of the logits inside each bag."""
    bands = df.select("slide_id", _band(F.col(logit_col)).alias("band"), _in_band(F.col(logit_col)).alias("w"))
    bands = bands.groupBy("slide_id", "band").agg(F.sum("w").alias("w")).withColumn("f", _to_top_band())
    total = bands.groupBy("slide_id").agg(
        (F.log(F.sum(F.col("w") * F.col("f"))) + (F.max("band") + 1) * F.lit(_BAND)).alias("__lse")
    )
    spread = [c for c in ("patch_idx", logit_col) if c in df.columns]
    joined = lookup(df, total, ["slide_id"], spread)
    return joined.withColumn("attention", F.exp(F.col(logit_col) - F.col("__lse"))).drop("__lse")


POOLERS: dict[str, Callable[..., DataFrame]] = {
    "attention": attention_pool,
    "max": pool_max,
    "mean": pool_mean,
}


def register_pooler(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Decorator that adds a pooling transform under a name."""

    def add(pooler: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in POOLERS:
            raise ValueError(f"Pooler '{name}' is already registered")
        POOLERS[name] = pooler
        return pooler

    return add


def get_pooler(name: str) -> Callable[..., DataFrame]:
    if name not in POOLERS:
        raise ValueError(f"Unknown pooler '{name}'. Available: {sorted(POOLERS)}")
    return POOLERS[name]
