"""Calibration, Brier scores and behaviour around a decision threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.probs import argmax, array_total, clip_unit, with_probs
from bagstats.operators.scores import class_rows


def brier(preds: DataFrame, by: Sequence[str] = (), prob: str = "prob_1") -> DataFrame:
    """Binary form: mean squared distance of the probability from the outcome."""
    gap = clip_unit(prob) - F.col("label")
    return preds.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def brier_multiclass(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vector form: squared distances summed over classes (twice the binary value for two classes)."""
    vectors = with_probs(preds)
    gaps = F.transform("probs", lambda p, i: (p - (i == F.col("label")).cast("double")))
    squares = array_total(F.transform(gaps, lambda g: g * g))
    return vectors.groupBy(*by).agg(F.avg(squares).alias("brier_multiclass"))


def brier_per_class(preds: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    gap = F.col("score") - F.col("positive")
    return class_rows(preds, n_classes, by).groupBy(*by, "class_id").agg(F.avg(gap * gap).alias("brier"))


def bin_edges(n_bins: int) -> list[float]:
    """Evenly spaced edges from 0 to 1 as doubles: i * (1 / n), the last one exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _bin_of(value: Column, n_bins: int) -> Column:
    """Bin by the double edges themselves: a first guess, moved by one where rounding was off."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    guess = F.least(F.greatest(F.floor(value * n_bins).cast("int"), F.lit(0)), F.lit(n_bins - 1))
    low, high = F.element_at(edges, guess + 1), F.element_at(edges, guess + 2)
    moved = F.when(value < low, guess - 1).when((value >= high) & (guess < n_bins - 1), guess + 1).otherwise(guess)
    return F.when((value >= 0) & (value <= 1), moved)


def with_confidence(preds: DataFrame) -> DataFrame:
    """Add the probability of the predicted class and whether that class is right."""
    best = argmax("probs")
    return with_probs(preds).select(
        "*", F.array_max("probs").alias("confidence"), (best == F.col("label")).cast("double").alias("correct")
    )


def bin_confidence(df: DataFrame, n_bins: int = 10, confidence: str = "confidence") -> DataFrame:
    """Add ``bin`` for a confidence column; bins are half open, the last one closed."""
    return df.withColumn("bin", _bin_of(F.col(confidence), n_bins))


def calibration_bins(preds: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Reliability table: every bin once, empty ones with nulls."""
    binned = bin_confidence(with_confidence(preds), n_bins)
    stats = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("correct").alias("avg_accuracy"),
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("bin_lower"), F.lit(hi).alias("bin_upper"))
            for i, (lo, hi) in enumerate(zip(bin_edges(n_bins)[:-1], bin_edges(n_bins)[1:], strict=True))
        ]
    )
    groups = stats.select(*by).distinct() if by else stats.agg(F.count(F.lit(1)).alias("__n"))
    spine = groups.select(*by, F.inline(entries))
    full = spine.join(stats, [*by, "bin"], "left")
    return full.select(
        *by,
        "bin",
        "bin_lower",
        "bin_upper",
        ((F.col("bin_lower") + F.col("bin_upper")) / 2).alias("bin_center"),
        "avg_confidence",
        "avg_accuracy",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.abs(F.col("avg_confidence") - F.col("avg_accuracy")).alias("gap"),
    )


def ece(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gap of the bins weighted by their share of the rows."""
    weighted = F.sum(F.coalesce("gap", F.lit(0.0)) * F.col("count"))
    return bins.groupBy(*by).agg((weighted / F.sum("count")).alias("ece"))


# --- thresholds -------------------------------------------------------------


def at_thresholds(
    preds: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), score: str = "prob_1"
) -> DataFrame:
    """Confusion counts and rates at every threshold of a list, in one pass over the predictions.

    A row is counted once, under the number of thresholds it reaches; suffix sums
    over those few counts give every threshold.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    reached = sum(((F.col(score) >= t).cast("int") for t in ordered), F.lit(0))
    counts = preds.select(*by, reached.alias("reached"), (F.col("label") == 1).cast("bigint").alias("y")).groupBy(
        *by, "reached"
    ).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    levels = F.sequence(F.lit(0), F.lit(len(ordered)))
    groups = counts.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    spine = groups.withColumn("reached", F.explode(levels))
    full = spine.join(counts, [*by, "reached"], "left")
    above = Window.partitionBy(*by).orderBy(F.col("reached").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select(
        *by,
        "reached",
        "n_pos",
        "n_neg",
        F.sum(F.coalesce("p", F.lit(0))).over(above).alias("tp"),
        F.sum(F.coalesce("n", F.lit(0))).over(above).alias("fp"),
    ).filter("reached > 0")
    table = F.array(*[F.lit(t) for t in ordered])
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return sums.select(
        *by,
        F.element_at(table, F.col("reached")).alias("threshold"),
        tp,
        fp,
        fn.alias("fn"),
        tn.alias("tn"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("ppv"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(tp + tn, tp + fn + tn + fp).alias("accuracy"),
    )


# Change of sensitivity within 0.01 that still earns each grade.
GRADE_LIMITS = (("A", 0.02), ("B", 0.05), ("C", 0.10))
WORST_GRADE = "D"
DEFAULT_DELTAS = (0.01, 0.02, 0.05, 0.10)


def threshold_stability(
    preds: DataFrame,
    base: float,
    deltas: Sequence[float] = DEFAULT_DELTAS,
    by: Sequence[str] = (),
    score: str = "prob_1",
) -> DataFrame:
    """Rates at the base threshold and around it, with changes, largest changes and a grade."""
    moves = [0.0, *[sign * d for d in deltas for sign in (-1, 1)]]
    spots = {d: max(0.0, min(1.0, base + d)) for d in moves}
    rates = at_thresholds(preds, list(spots.values()), by, score)
    near = F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(t).alias("threshold")) for d, t in spots.items()])
    matching = F.filter(near, lambda e: e["threshold"] == F.col("threshold"))
    rows = rates.withColumn("delta", F.explode(F.transform(matching, lambda e: e["delta"])))
    group = Window.partitionBy(*by)  # one row per delta
    names = ("sensitivity", "specificity", "ppv", "npv")
    for name in names:
        at_base = F.max(F.when(F.col("delta") == 0, F.col(name))).over(group)
        rows = rows.withColumn(f"{name}_change", F.col(name) - at_base)
    change = F.abs(F.col("sensitivity_change"))
    for label, limit in (("01", 0.011), ("05", 0.051)):
        inside = (F.abs(F.col("delta")) <= limit) & (F.col("delta") != 0)
        rows = rows.withColumn(
            f"max_sens_change_{label}", F.coalesce(F.max(F.when(inside, change)).over(group), F.lit(0.0))
        )
    grade = None
    for letter, limit in GRADE_LIMITS:
        met = F.col("max_sens_change_01") <= limit
        grade = F.when(met, letter) if grade is None else grade.when(met, letter)
    return rows.withColumn("stability_grade", grade.otherwise(WORST_GRADE))
