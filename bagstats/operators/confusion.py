"""Metrics that follow from the confusion counts.

One aggregate turns predictions into ``label, pred, n``; everything else works on
that table, which has at most classes * classes rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.probs import array_total, with_prediction, with_probs

# Fixed value: spacing of double precision numbers at one, the clip of the log loss.
DOUBLE_EPSILON = 2.220446049250313e-16
# Fixed value: logits are clamped to this range before a loss is taken.
LOGIT_LIMIT = 100.0


def confusion_counts(
    preds: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, weight: str | None = None
) -> DataFrame:
    """``label, pred, n`` for every combination that occurs."""
    rows = preds if "pred" in preds.columns else with_prediction(preds, threshold)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.groupBy(*by, "label", "pred").agg(amount.alias("n"))


def confusion_matrix(preds: DataFrame, n_classes: int, by: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """Counts on the whole class grid; with ``normalize`` also the share of the true class.

    A label or prediction outside ``0 .. n_classes - 1``, or none, fails the job.
    """
    counts = confusion_counts(preds, by)
    inside = F.col("label").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1)
    text = F.concat_ws(" ", F.lit(f"outside {n_classes} classes: label"), F.col("label").cast("string"), F.lit("pred"), F.col("pred").cast("string"))
    counts = counts.withColumn("n", F.when(F.coalesce(inside, F.lit(False)), F.col("n")).otherwise(F.raise_error(text).cast("bigint")))
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    groups = counts.groupBy(*by).agg(F.lit(1).alias("__one")) if by else counts.agg(F.count(F.lit(1)).alias("__one"))
    grid = groups.withColumn("label", F.explode(classes)).withColumn("pred", F.explode(classes)).drop("__one")
    # A full join, so that no row outside the grid is passed over before it is refused.
    full = grid.join(counts, [*by, "label", "pred"], "full").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    if not normalize:
        return full
    total = F.sum("n").over(Window.partitionBy(*by, "label"))
    return full.withColumn("row_share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def _aggregates(texts: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in texts.items()]


def _ratio(top: str, bottom: str) -> str:
    return f"if({bottom} > 0, ({top}) / ({bottom}), 0.0D)"


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class seen in truth or prediction: hits, support, predicted, and the group's total."""
    rows = counts.selectExpr(
        *by,
        """inline(array(
             struct(label AS class_id, if(label = pred, n, 0L) AS tp, n AS support, 0L AS predicted),
             struct(pred AS class_id, 0L AS tp, 0L AS support, n AS predicted)))""",
    )
    sums = {c: f"cast(sum({c}) AS double)" for c in ("tp", "support", "predicted")}
    table = rows.groupBy(*by, "class_id").agg(*_aggregates(sums))
    return table.withColumn("total", F.sum("support").over(Window.partitionBy(*by)))


def class_scores(classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and specificity per class; an empty denominator gives 0."""
    scores = {
        "precision": _ratio("tp", "predicted"),
        "recall": _ratio("tp", "support"),
        "f1": _ratio("2 * tp", "support + predicted"),
        "specificity": _ratio("total - support - (predicted - tp)", "total - support"),
    }
    return classes.selectExpr("*", *[f"{text} AS {name}" for name, text in scores.items()])


def overall_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All single-number metrics of the confusion table, one row per group."""
    rows = class_scores(per_class(counts, by))
    averaged = ("precision", "recall", "f1")
    sums = rows.groupBy(*by).agg(
        *_aggregates(
            {
                "n": "sum(support)",
                "hits": "sum(tp)",
                "n_true_classes": "count_if(support > 0)",
                "sp": "sum(support * predicted)",
                "ss": "sum(support * support)",
                "pp": "sum(predicted * predicted)",
                "balanced_accuracy": "avg(if(support > 0, recall, NULL))",
                **{f"{m}_macro": f"avg({m})" for m in averaged},
                **{f"{m}_weighted": f"sum({m} * support) / sum(support)" for m in averaged},
            }
        )
    )
    return sums.selectExpr(
        *by,
        "cast(n AS bigint) AS n",
        "n_true_classes",
        "hits / n AS accuracy",
        "balanced_accuracy",
        "if(sp < n * n, (hits / n - sp / (n * n)) / (1 - sp / (n * n)), NULL) AS kappa",
        "if((n * n - pp) * (n * n - ss) > 0, (hits * n - sp) / sqrt((n * n - pp) * (n * n - ss)), 0.0D) AS mcc",
        *[f"{m}_{kind}" for m in averaged for kind in ("macro", "weighted")],
    )


def accuracy_suite(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return overall_scores(counts, by).select(*by, "n", "accuracy", "balanced_accuracy", "kappa", "mcc")


def prf_suite(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted precision, recall and F1."""
    names = [f"{m}_{kind}" for m in ("precision", "recall", "f1") for kind in ("macro", "weighted")]
    return overall_scores(counts, by).select(*by, *names)


def prf_per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_scores(per_class(counts, by)).select(
        *by, "class_id", F.col("support").cast("bigint").alias("support"), "precision", "recall", "f1"
    )


def specificity_per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_scores(per_class(counts, by)).select(*by, "class_id", "specificity")


def sample_log_loss() -> Column:
    """Negative log of the probability given to the true class, clipped away from 0 and 1."""
    p = F.element_at("probs", F.col("label") + 1)
    return -F.log(F.least(F.greatest(p, F.lit(DOUBLE_EPSILON)), F.lit(1.0 - DOUBLE_EPSILON)))


def log_loss(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log probability of the true class."""
    return with_probs(preds).groupBy(*by).agg(F.avg(sample_log_loss()).alias("log_loss"))


def loss_report(
    rows: DataFrame,
    kind: str = "ce",
    weights: Sequence[float] | None = None,
    gamma: float = 2.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Training loss of stored ``logits``: cross-entropy, binary cross-entropy or focal."""
    z = F.transform("logits", lambda v: F.least(F.greatest(v.cast("double"), F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT)))
    clamped = rows.withColumn("__z", z)
    label = F.col("label")
    weight = F.lit(1.0)
    if weights is not None and kind != "bce":
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), label + 1)
    if kind == "bce":
        one = F.when(F.size("__z") == 1, F.col("__z")[0]).otherwise(
            F.raise_error(F.lit("bce needs a single logit per row")).cast("double")
        )
        boost = weights[1] / weights[0] if weights is not None and len(weights) == 2 else 1.0
        y = label.cast("double")
        soft = F.log1p(F.exp(-F.abs(one))) + F.greatest(-one, F.lit(0.0))
        loss = (F.lit(1.0) - y) * one + (F.lit(1.0) + F.lit(boost - 1.0) * y) * soft
        return clamped.groupBy(*by).agg(F.avg(loss).alias("loss"))
    top = F.array_max("__z")
    total = F.log(array_total(F.transform("__z", lambda v: F.exp(v - top)))) + top
    entropy = total - F.element_at("__z", label + 1)
    if kind == "ce":
        return clamped.groupBy(*by).agg((F.sum(weight * entropy) / F.sum(weight)).alias("loss"))
    if kind == "focal":
        weighted = weight * entropy
        loss = F.pow(F.lit(1.0) - F.exp(-weighted), F.lit(float(gamma))) * weighted
        return clamped.groupBy(*by).agg(F.avg(loss).alias("loss"))
    raise ValueError(f"Unknown loss '{kind}'. Use 'ce', 'bce' or 'focal'.")
