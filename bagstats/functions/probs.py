"""Probability vectors: clean-up, conversion from logits, predicted class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip_unit(prob: str | Column) -> Column:
    """Binary probability forced into [0, 1]; null and NaN stay what they are."""
    value = _column(prob)
    missing = value.isNull() | F.isnan(value.cast("double"))
    return F.when(missing, value).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often and at whatever depth it is used."""
    return F.transform(F.array(value), use)[0]


def divided(values: Column, total: Column) -> Column:
    """Every entry over the total, which is taken once; a total of zero leaves the vector as it is."""
    return once(F.when(total == 0, F.lit(1.0)).otherwise(total), lambda t: F.transform(values, lambda v: v / t))


def renormalize_probs(probs: str | Column) -> Column:
    """Divide a vector by its sum; an all-zero vector stays as it is."""
    return once(_column(probs), lambda values: divided(values, array_total(values)))


def softmax(logits: Column) -> Column:
    """Exponentials over their sum, with the largest logit taken off first; a null entry gives null entries."""
    powers = once(logits, lambda z: once(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
    return once(powers, lambda p: divided(p, array_total(p)))


def probs_from_logits(logits: str | Column) -> Column:
    """Sigmoid of one logit, softmax of several; always an array.

    One logit gives ``[p]``, two give ``[P(class 1)]``, more give the whole vector.
    """
    z = _column(logits)
    return (
        F.when(F.size(z) == 1, F.transform(z, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))))
        .when(F.size(z) == 2, F.slice(softmax(z), 2, 1))
        .otherwise(softmax(z))
    )


def argmax(values: str | Column) -> Column:
    """Zero-based position of the first maximum."""
    return once(_column(values), lambda arr: (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))


def predict_class(probs: str | Column, threshold: float = 0.5) -> Column:
    """One probability is compared with the threshold; a vector gives its first maximum."""
    arr = _column(probs)
    return F.when(F.size(arr) == 1, (arr[0] >= threshold).cast("int")).otherwise(argmax(arr))


def top_class(probs: str | Column) -> Column:
    """Struct of the first best class and its probability."""
    arr = _column(probs)
    return F.struct(argmax(arr).alias("pred_class"), F.array_max(arr).alias("pred_prob"))


def prob_columns(df: DataFrame) -> list[str]:
    """Columns ``prob_0, prob_1, ...`` in numeric order."""
    found = [c for c in df.columns if c.startswith("prob_") and c[5:].isdigit()]
    return sorted(found, key=lambda c: int(c[5:]))


def with_probs(df: DataFrame) -> DataFrame:
    """Add the canonical ``probs`` vector (one entry per class) from ``prob_*`` columns.

    A single ``prob_1`` column is the binary form: it is clipped and becomes ``[1 - p, p]``.
    """
    if "probs" in df.columns:
        return df
    names = prob_columns(df)
    if not names:
        raise ValueError(f"No probability columns (prob_*) found. Available: {df.columns}")
    if names == ["prob_1"]:
        p = clip_unit("prob_1")
        return df.withColumn("probs", F.array(F.lit(1.0) - p, p))
    return df.withColumn("probs", renormalize_probs(F.array(*[F.col(c).cast("double") for c in names])))


def with_prediction(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``pred``: threshold rule for the binary column form, first maximum for vectors."""
    names = prob_columns(df)
    if "probs" not in df.columns and names == ["prob_1"]:
        return df.withColumn("pred", (clip_unit("prob_1") >= threshold).cast("int"))
    vectors = with_probs(df)
    return vectors.withColumn("pred", argmax("probs"))
