"""Prediction tables: collecting, averaging over models and crops, patient level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstats.functions.probs import prob_columns, with_probs


def sized(name: str, n_classes: int) -> Column:
    """A probability vector that must have ``n_classes`` entries: the job fails on any other."""
    text = F.concat(F.lit(f"expected {n_classes} classes, found "), F.size(name).cast("string"))
    failure = F.raise_error(text).cast("array<double>")
    return F.when(F.coalesce(F.size(name), F.lit(n_classes)) == n_classes, F.col(name).cast("array<double>")).otherwise(failure)


def _averages(df: DataFrame, n_classes: int | None) -> list:
    """Mean of every probability column, or of every entry of ``probs``."""
    if "probs" in df.columns:
        if not n_classes:
            raise ValueError("n_classes is needed to average a probs vector")
        vector = sized("probs", n_classes)
        return [F.array(*[F.avg(vector[c]) for c in range(n_classes)]).alias("probs")]
    names = prob_columns(df)
    if not names:
        raise ValueError(f"No probability columns (prob_*) found. Available: {df.columns}")
    return [F.avg(c).alias(c) for c in names]


def collect_predictions(scored: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per slide (and fold or model): repeats from padded workers are dropped."""
    keys = [c for c in ("model", "fold", "slide_id") if c in scored.columns]
    row = F.struct(*[F.col(c) for c in scored.columns])
    order = F.col(order_col) if order_col else row
    return scored.groupBy(*keys).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def oof_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack the validation predictions of every fold; frame i is fold i unless it says so."""
    out = None
    for number, frame in enumerate(frames):
        named = frame if "fold" in frame.columns else frame.withColumn("fold", F.lit(number))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("No fold predictions given")
    return out


def crop_average(preds: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Mean probabilities per slide over its crops."""
    return preds.groupBy("slide_id").agg(F.min("label").alias("label"), *_averages(preds, n_classes))


def ensemble_average(preds: DataFrame, n_models: int | None = None, n_classes: int | None = None) -> DataFrame:
    """Mean probabilities per slide over models, joined by id; fails on a slide that lacks a model."""
    out = preds.groupBy("slide_id").agg(
        F.min("label").alias("label"),
        F.count_distinct("model").alias("n_models") if "model" in preds.columns else F.count(F.lit(1)).alias("n_models"),
        *_averages(preds, n_classes),
    )
    if n_models is None:
        return out
    text = F.concat(F.lit(f"expected {n_models} models for slide "), F.col("slide_id").cast("string"))
    checked = F.when(F.col("n_models") == n_models, F.col("n_models"))
    return out.withColumn("n_models", checked.otherwise(F.raise_error(text).cast("bigint")))


def average_probs(frames: Sequence[DataFrame], n_classes: int | None = None) -> DataFrame:
    """Align several prediction tables by slide and average them (a union, not a join)."""
    tagged = [f.withColumn("model", F.lit(i)) for i, f in enumerate(frames)]
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other)
    return ensemble_average(stacked, len(frames), n_classes)


def patient_aggregate(
    preds: DataFrame, by: Sequence[str] = (), patient_col: str = "patient_id", n_classes: int | None = None
) -> DataFrame:
    """Patient level: mean probabilities, most frequent label (smallest on ties), slide count.

    Slides without a patient are patients of their own and keep a null there.
    """
    rows = preds if patient_col in preds.columns else preds.withColumn(patient_col, F.col("slide_id"))
    alone = F.when(F.col(patient_col).isNull(), F.col("slide_id"))
    return rows.groupBy(*by, patient_col, alone.alias("__alone")).agg(
        F.mode("label", True).alias("label"),
        F.count("slide_id").alias("n_slides"),
        *_averages(rows, n_classes),
    ).drop("__alone")


def class_rows(preds: DataFrame, n_classes: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row per prediction and class: ``class_id, score, positive`` (one-vs-rest); a label outside the classes fails the job."""
    vectors = with_probs(preds)
    exploded = vectors.select(*keep, "label", F.posexplode(sized("probs", n_classes)).alias("class_id", "score"))
    inside = F.coalesce(F.col("label").between(0, n_classes - 1), F.lit(False))
    text = F.concat(F.lit(f"label outside {n_classes} classes: "), F.coalesce(F.col("label").cast("string"), F.lit("null")))
    positive = F.when(inside, (F.col("label") == F.col("class_id")).cast("bigint")).otherwise(F.raise_error(text).cast("bigint"))
    return exploded.select(*keep, "class_id", "score", positive.alias("positive"))
