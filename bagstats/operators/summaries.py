"""Reports built from the metric operators: full suite, per fold and pooled, fold statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.probs import with_prediction, with_probs
from bagstats.functions.spread import exact_quantiles
from bagstats.operators.confusion import class_scores, overall_scores, per_class, sample_log_loss
from bagstats.operators.ranking import auroc_per_class
from bagstats.operators.scores import patient_aggregate

# Rules for the length of the final training run.
EPOCH_RULES = ("p75", "median", "max", "mean")

_OVERALL = (
    "accuracy",
    "balanced_accuracy",
    "kappa",
    "mcc",
    "precision_macro",
    "precision_weighted",
    "recall_macro",
    "recall_weighted",
    "f1_macro",
    "f1_weighted",
)
_PER_CLASS = ("precision", "recall", "f1", "specificity")


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str], class_id: str = "cast(NULL AS int)") -> DataFrame:
    entries = ", ".join(f"struct('{n}' AS metric, cast({n} AS double) AS value)" for n in names)
    return df.selectExpr(*by, f"{class_id} AS class_id", f"inline(array({entries}))")


def _auroc_rows(preds: DataFrame, n_classes: int, by: Sequence[str]) -> DataFrame:
    """AUROC per class and overall from one pass: the overall row rides on the last class.

    With two classes the overall value is that of class 1, otherwise the mean, and
    null unless every class has a value.
    """
    per = auroc_per_class(preds, n_classes, by)
    if n_classes == 2:
        per = per.withColumn("overall", F.col("auroc"))
    else:
        group = Window.partitionBy(*by)  # one row per class
        per = per.withColumn("overall", F.when(F.count("auroc").over(group) == n_classes, F.avg("auroc").over(group)))
    own = "struct(class_id, 'auroc' AS metric, auroc AS value)"
    whole = "struct(cast(NULL AS int) AS class_id, 'auroc_macro' AS metric, overall AS value)"
    return per.selectExpr(*by, f"inline(if(class_id = {n_classes - 1}, array({own}, {whole}), array({own})))")


def metrics_suite(preds: DataFrame, n_classes: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Every metric in long form: ``<by>, class_id, metric, value`` (class_id null for overall values).

    Two passes over the predictions: one for the confusion counts, which carry the
    log loss along, and one for the scores.
    """
    by = list(by)
    rows = with_probs(with_prediction(preds)).withColumn("__loss", sample_log_loss())
    counts = rows.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("__loss").alias("loss"))
    overall = overall_scores(counts, by).withColumn("n_samples", F.col("n"))
    loss = counts.groupBy(*by).agg((F.sum("loss") / F.sum("n")).alias("log_loss"))
    classes = class_scores(per_class(counts, by))
    parts = [
        _long(overall, by, ["n_samples", *_OVERALL]),
        _long(classes, by, _PER_CLASS, "class_id"),
        _long(loss, by, ["log_loss"]),
        _auroc_rows(preds, n_classes, by),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scoped(preds: DataFrame) -> DataFrame:
    """Every row under its fold and under ``pooled`` (what a grouping set would do)."""
    both = F.array(F.col("fold").cast("string"), F.lit("pooled"))
    return preds.withColumn("scope", F.explode(both))


def per_fold_and_pooled(preds: DataFrame, n_classes: int = 2, patient_col: str = "patient_id") -> DataFrame:
    """The suite per fold and over all folds, for slides and for patients, in one job."""
    scoped = _scoped(preds)
    slides = metrics_suite(scoped, n_classes, ["scope"]).withColumn("level", F.lit("slide"))
    patients = patient_aggregate(scoped, ["scope"], patient_col, n_classes)
    return slides.unionByName(metrics_suite(patients, n_classes, ["scope"]).withColumn("level", F.lit("patient")))


def fold_metric_summary(metrics: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean, population deviation, extremes and count over folds; missing and non-finite values are skipped."""
    value = F.col("value").cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    sums = metrics.groupBy(*keys).agg(
        F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("std"),
        F.min(finite).alias("min"),
        F.max(finite).alias("max"),
        F.count(finite).alias("n_folds"),
    )
    return sums.filter("n_folds > 0")


def best_fold(fold_metrics: DataFrame, metric: str, mode: str = "min") -> DataFrame:
    """Fold with the best value of one metric; the first fold on ties, folds without it skipped."""
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', got '{mode}'")
    rows = fold_metrics.filter((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan("value"))
    key = F.col("value") if mode == "min" else -F.col("value")
    best = rows.groupBy("metric").agg(F.min_by(F.struct("fold", "value"), F.struct(key, F.col("fold"))).alias("b"))
    return best.select("metric", F.col("b.fold").alias("fold"), F.col("b.value").alias("value"))


def refit_epochs(fold_metrics: DataFrame, rule: str = "p75", fallback: int = 30, epoch_col: str = "best_epoch") -> DataFrame:
    """Epochs for the final run from the folds' best epochs: rounded up, at least one."""
    if rule not in EPOCH_RULES:
        raise ValueError(f"Unknown rule '{rule}'. Choose from {list(EPOCH_RULES)}")
    value = F.when(F.col(epoch_col) > 0, F.col(epoch_col).cast("double"))
    picked = {
        "p75": F.percentile(value, 0.75),
        "median": F.percentile(value, 0.5),
        "max": F.max(value),
        "mean": F.avg(value),
    }[rule]
    row = fold_metrics.agg(picked.alias("v"), F.count(value).alias("n_folds"))
    epochs = F.greatest(F.lit(1), F.ceil(F.round("v", 9)).cast("int"))
    return row.select(
        F.lit(rule).alias("rule"),
        F.when(F.col("n_folds") == 0, F.lit(fallback)).otherwise(epochs).alias("epochs"),
        "n_folds",
    )


def timing_summary(df: DataFrame, phase_col: str = "phase", ms_col: str = "ms") -> DataFrame:
    """Statistics of the timings of every phase."""
    rows = df.select(F.col(phase_col).alias("phase"), F.col(ms_col).cast("double").alias("ms"))
    sums = rows.groupBy("phase").agg(
        F.count("ms").alias("n_iters"),
        F.avg("ms").alias("mean_ms"),
        F.stddev_pop("ms").alias("std_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )
    quantiles = exact_quantiles(rows, ["phase"], "ms", {"median_ms": 0.5, "p10_ms": 0.1, "p90_ms": 0.9})
    rate = F.when(F.col("mean_ms") > 0, F.lit(1000.0) / F.col("mean_ms"))
    return sums.join(quantiles, "phase").withColumn("items_per_sec", rate)


def phase_shares(summary: DataFrame, whole: str | None = None, residual: str = "rest") -> DataFrame:
    """``phase, mean_ms, share, place, slowest`` of a timing summary: where the time of one round goes.

    ``whole`` names a phase that spans the others; it is then split into them and, under the name
    ``residual``, what they leave of it.  Without it the phases simply follow each other.  Phases without a mean
    have no part; equal means are placed by name.  The table has a row per phase, so its windows are small.
    """
    parts = summary.select("phase", "mean_ms").filter("mean_ms is not null and not isnan(mean_ms)")
    if whole is not None:
        spans = F.col("phase") == whole
        rest = parts.agg(
            (F.max(F.when(spans, F.col("mean_ms"))) - F.coalesce(F.sum(F.when(~spans, F.col("mean_ms"))), F.lit(0.0))).alias("mean_ms")
        )
        rest = rest.select(F.lit(residual).alias("phase"), "mean_ms").filter("mean_ms > 0")
        parts = parts.filter(~spans).unionByName(rest)
    every = Window.partitionBy()
    total = F.sum("mean_ms").over(every)
    place = F.row_number().over(every.orderBy(F.col("mean_ms").desc(), "phase"))
    share = F.when(total > 0, F.col("mean_ms") / total)
    return parts.select("phase", "mean_ms", share.alias("share"), place.alias("place"), (place == 1).alias("slowest"))
