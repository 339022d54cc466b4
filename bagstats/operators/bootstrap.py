"""Bootstrap intervals: all draws, all metrics, one job.

Two ways to resample.  ``poisson`` gives every unit an independent Poisson(1) weight per
repeat; weights are handled as arrays over the repeats (see ``weights``), so no row is multiplied and nothing is
joined: this is the form for tables of any size.  ``exact`` makes n draws of n units, each draw a keyed hash of
(repeat, draw number): n times repeats draws, made and counted where their repeat is evaluated (see ``draws``).  Only for custom metrics
they are packed into bytes and counted per unit, whose counts are its weights from there on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstats.functions.keys import hash_bucket, hash_key
from bagstats.functions.probs import with_prediction, with_probs
from bagstats.functions.spread import lookup, ranked, spread_out
from bagstats.operators.confusion import overall_scores
from bagstats.operators.draws import exact_repeats
from bagstats.operators.ranking import auroc_from_scores, auroc_macro, refused_unless_scored
from bagstats.operators.scores import patient_aggregate, sized
from bagstats.operators.weights import auroc_draws, confusion_draws, drawn_weights, unit_key, weighted_rows
from bagstats.sources.shared import written

# Metrics reported with an interval, and the fewest usable repeats.
CI_METRICS = (
    "accuracy",
    "auroc",
    "balanced_accuracy",
    "f1_macro",
    "f1_weighted",
    "kappa",
    "precision_macro",
    "recall_macro",
)
MIN_VALID = 10


def _rows(preds: DataFrame, unit: str, by: Sequence[str], score: str, n_classes: int) -> DataFrame:
    """``by, unit, label, pred, score`` of every prediction; the score is that of class 1, or the vector of more classes.

    Rows without a unit are units of their own.
    """
    rows = with_prediction(preds)
    own = F.col(unit)
    if unit != "slide_id" and "slide_id" in preds.columns:
        alone = F.concat(F.lit("slide "), F.col("slide_id").cast("string"))
        has_null = preds.schema[unit].nullable
        own = F.coalesce(own.cast("string"), alone) if has_null else own
    if n_classes == 2 and score in rows.columns:
        value = F.col(score)
    else:
        rows = with_probs(rows)
        value = sized("probs", n_classes)
        value = value[1] if n_classes == 2 else value
    return rows.select(*by, own.alias("unit"), "label", "pred", value.alias("score"))


def _cells(preds: DataFrame, unit: str, by: Sequence[str], score: str, n_classes: int = 2) -> DataFrame:
    """Per unit: counts by label, prediction and score, so a unit with many rows shrinks first."""
    rows = _rows(preds, unit, by, score, n_classes)
    return rows.groupBy(*by, "unit", "label", "pred", "score").agg(F.count(F.lit(1)).alias("n"))


def resample(
    preds: DataFrame,
    unit: str,
    n_bootstrap: int,
    seed: int = 42,
    by: Sequence[str] = (),
    score: str = "prob_1",
    mode: str = "exact",
    n_classes: int = 2,
) -> DataFrame:
    """``b, label, pred, score, n`` of every resample as rows, not yet added up: for ``exact`` draws and for custom metrics.

    Each metric adds the rows up on the map side by the columns it needs.
    """
    by = list(by)
    cells = _cells(preds, unit, by, score, n_classes)
    if mode == "poisson":
        cells = spread_out(cells, "unit", "score").withColumn("__unit", unit_key(seed, "unit"))
    elif mode == "exact":
        cells = spread_out(cells.join(_drawn_units(cells, by, seed, n_bootstrap), [*by, "unit"]), "unit", "score")
    else:
        raise ValueError(f"Unknown resampling mode '{mode}'. Use 'exact' or 'poisson'.")
    drawn = weighted_rows(cells.drop("unit"), n_bootstrap)
    return drawn.select(*by, "b", "label", "pred", "score", "n")


def _numbered_units(rows: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """``by, unit, unit_no, n_units``: the numbers by which units are drawn."""
    units = rows.select(*by, "unit").distinct().withColumn("__key", hash_key(seed, "unit"))
    return ranked(
        units, by, [F.col("__key"), F.col("unit")], [hash_bucket(F.col("__key"))], rank="unit_no", total="n_units"
    ).drop("__key")


def _drawn_units(rows: DataFrame, by: Sequence[str], seed: int, n_bootstrap: int) -> DataFrame:
    """``by, unit, __unit`` of n draws of n units, written once: every metric reads the same draws."""
    by = list(by)
    numbered = _numbered_units(rows, by, seed)
    weights = drawn_weights(numbered, by, seed, n_bootstrap)
    return written(numbered.drop("n_units").join(weights, [*by, "unit_no"]).select(*by, "unit", "__unit"), "draws")


def _table_rows(counts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long ``metric, value`` of the metrics that follow from confusion counts."""
    scores = overall_scores(counts, by)
    usable = F.col("n_true_classes") >= 2
    entries = [F.struct(F.lit(m).alias("metric"), F.when(usable, F.col(m)).alias("value")) for m in names]
    return scores.select(*by, F.inline(F.array(*entries)))


def _auroc_rows(values: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    """Long ``metric, value`` from a table with ``auroc``, of classes if there are more than two."""
    if n_classes > 2:
        values = auroc_macro(values, by).withColumnRenamed("auroc_macro", "auroc")
    return values.select(*by, F.lit("auroc").alias("metric"), F.col("auroc").alias("value"))


def _metric_rows(cells: DataFrame, by: Sequence[str], names: Sequence[str], n_classes: int = 2) -> DataFrame:
    """Long ``metric, value`` for weighted cells."""
    parts = []
    table_metrics = [m for m in names if m != "auroc"]
    if table_metrics:
        counts = cells.groupBy(*by, "label", "pred").agg(F.sum("n").alias("n"))
        parts.append(_table_rows(counts, by, table_metrics))
    if "auroc" in names:
        keys = [*by, "class_id"] if n_classes > 2 else list(by)
        if n_classes > 2:
            cells = cells.select(*by, "label", "n", F.posexplode("score").alias("class_id", "score"))
        is_hit = F.col("label") == (F.col("class_id") if n_classes > 2 else F.lit(1))
        hit, miss = F.when(is_hit, F.col("n")), F.when(~is_hit, F.col("n"))
        scored = cells.groupBy(*keys, "score").agg(
            F.coalesce(F.sum(hit), F.lit(0)).alias("pos"), F.coalesce(F.sum(miss), F.lit(0)).alias("neg")
        )
        parts.append(_auroc_rows(auroc_from_scores(scored, keys), by, n_classes))
    return reduce(DataFrame.unionByName, parts)


def _weighted_rows(
    rows: DataFrame, by: Sequence[str], names: Sequence[str], n_bootstrap: int, seed: int, n_classes: int, mode: str = "poisson"
) -> DataFrame:
    """Long ``b, metric, value`` of resamples, without a row per repeat."""
    exact = mode == "exact"
    if exact:
        numbers = _numbered_units(rows, by, seed)
        keyed = written(rows.join(numbers, [*by, "unit"]).select(*by, "label", "pred", "score", "unit_no", "n_units"), "draws")
        unit = ["unit_no", "n_units"]
    else:
        keyed = rows.select(*by, "label", "pred", "score", unit_key(seed, "unit").alias("__unit"))
        unit = ["__unit"]
    table_metrics = [m for m in names if m != "auroc"]
    keys = [*by, "class_id"] if n_classes > 2 else list(by)
    tables = keyed.drop("score") if table_metrics else None
    scored = None
    if "auroc" in names:
        scored = keyed.select(*by, "label", *unit, "score")
        if n_classes > 2:
            scored = keyed.select(*by, "label", *unit, F.posexplode("score").alias("class_id", "score"))
        if exact:  # as for the point value: null is the lowest score, NaN the highest, and no label is neither outcome
            positive = F.col("label") == (F.col("class_id") if n_classes > 2 else F.lit(1))
            value = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
            value = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
            scored = scored.filter(F.col("label").isNotNull())
        else:
            positive = F.col("label") == F.col("class_id") if n_classes > 2 else F.when(F.col("label").isin(0, 1), F.col("label") == 1)
            value = refused_unless_scored(F.col("score"), positive)
        scored = scored.select(*keys, value.alias("score"), positive.alias("positive"), *unit)
    if exact:
        counts, areas = exact_repeats(tables, scored, by, keys, seed, n_bootstrap)
    else:
        counts = None if tables is None else confusion_draws(tables, by, n_bootstrap)
        areas = None if scored is None else auroc_draws(scored, keys, n_bootstrap)
    parts = [] if counts is None else [_table_rows(counts, [*by, "b"], table_metrics)]
    if areas is not None:
        parts.append(_auroc_rows(areas, [*by, "b"], n_classes))
    return reduce(DataFrame.unionByName, parts)


def _intervals(values: DataFrame, by: Sequence[str], n_bootstrap: int, alpha: float) -> DataFrame:
    finite = F.when(~F.isnan("value"), F.col("value"))
    sums = values.groupBy(*by, "metric").agg(
        F.count(finite).alias("n_valid_bootstrap"),
        F.percentile(finite, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"),
        F.stddev_pop(finite).alias("se"),
    )
    enough = F.col("n_valid_bootstrap") >= MIN_VALID
    return sums.select(
        *by,
        "metric",
        F.when(enough, F.col("ci")[0]).alias("ci_lower"),
        F.when(enough, F.col("ci")[1]).alias("ci_upper"),
        F.when(enough, F.col("se")).alias("se"),
        "n_valid_bootstrap",
        F.lit(n_bootstrap).cast("bigint").alias("n_bootstrap"),
    )


def bootstrap_ci(
    preds: DataFrame,
    metric: str | Sequence[str] | Callable[[DataFrame, Sequence[str]], DataFrame] = CI_METRICS,
    unit: str = "patient_id",
    n_bootstrap: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
    by: Sequence[str] = (),
    score: str = "prob_1",
    mode: str = "poisson",
    n_classes: int = 2,
) -> DataFrame:
    """Point value, percentile interval and standard error per metric.

    ``unit`` is what is drawn (the slide when the column is missing).  Predictions may be a ``prob_1`` column, columns
    ``prob_0 ...`` or one ``probs`` vector; with more than two classes the AUROC is the mean of one class against the rest and
    missing in a resample that lacks a class.  A custom metric is a function of (weighted cells, grouping
    columns) that returns ``<grouping columns>, metric, value``; it needs a row per cell and repeat in either mode.
    """
    if mode not in ("exact", "poisson"):
        raise ValueError(f"Unknown resampling mode '{mode}'. Use 'exact' or 'poisson'.")
    by = list(by)
    drawn_unit = unit if unit in preds.columns else "slide_id"
    names = None if callable(metric) else [metric] if isinstance(metric, str) else list(metric)

    def measure(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        return metric(cells, keys) if names is None else _metric_rows(cells, keys, names, n_classes)

    point_cells = _rows(preds, drawn_unit, by, score, n_classes).groupBy(*by, "label", "pred", "score").agg(F.count(F.lit(1)).alias("n"))
    point = measure(point_cells, by).withColumnRenamed("value", "point")
    if names is not None:
        rows = _rows(preds, drawn_unit, by, score, n_classes)
        repeats = _weighted_rows(rows, by, names, n_bootstrap, seed, n_classes, mode)
    else:
        repeats = measure(resample(preds, drawn_unit, n_bootstrap, seed, by, score, mode, n_classes), [*by, "b"])
    intervals = _intervals(repeats, by, n_bootstrap, alpha)
    return lookup(point, intervals, [*by, "metric"], how="left")


def metrics_with_ci(
    preds: DataFrame,
    n_bootstrap: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
    patient_col: str = "patient_id",
    mode: str = "poisson",
    n_classes: int = 2,
) -> DataFrame:
    """All interval metrics for slides and for patients; the same draws serve every metric of a level.

    Without a patient column the patient rows repeat the slide rows.
    """
    options = {"n_bootstrap": n_bootstrap, "alpha": alpha, "seed": seed, "mode": mode, "n_classes": n_classes}
    slide = bootstrap_ci(preds, unit="slide_id", **options)
    if patient_col in preds.columns:
        patients = patient_aggregate(preds, patient_col=patient_col, n_classes=n_classes)
        patient = bootstrap_ci(patients, unit=patient_col, **options)
    else:
        patient = slide
    return slide.withColumn("level", F.lit("slide")).unionByName(patient.withColumn("level", F.lit("patient")))
