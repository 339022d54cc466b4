"""Metrics that need the order of the scores: ROC, precision-recall, operating points.

Rows with the same score are added up first.  The distinct scores are then cut
into buckets of about equal size (see ``even_buckets``), running sums are taken inside a bucket, and the
totals of the buckets before it are added: the same numbers as one global sort,
without a task that sees all scores, however narrow their range is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.spread import even_buckets, lookup
from bagstats.operators.scores import class_rows

def refused_unless_scored(score: Column, positive: Column) -> Column:
    """The score as a number, or the failure of the job: a null or NaN score, and an outcome that is neither 0 nor 1 (such as -1)."""
    fine = score.isNotNull() & ~F.isnan(score.cast("double")) & positive.cast("int").isin(0, 1)
    shown = [F.coalesce(c.cast("string"), F.lit("null")) for c in (score, positive)]
    text = F.concat(F.lit("cannot rank score "), shown[0], F.lit(" with outcome "), shown[1])
    return F.when(F.coalesce(fine, F.lit(False)), score.cast("double") + F.lit(0.0)).otherwise(F.raise_error(text).cast("double"))


def score_table(
    preds: DataFrame, by: Sequence[str] = (), score: str = "prob_1", positive: str = "label", weight: str | None = None
) -> DataFrame:
    """Positives and negatives per distinct score; a row that has no score, or an outcome other than 0 and 1, fails the job."""
    amount = F.col(weight) if weight else F.lit(1)
    is_positive = F.col(positive) == 1
    return (
        preds.select(
            *by,
            refused_unless_scored(F.col(score), F.col(positive)).alias("score"),
            F.when(is_positive, amount).otherwise(0).cast("bigint").alias("pos"),
            F.when(is_positive, 0).otherwise(amount).cast("bigint").alias("neg"),
        )
        .groupBy(*by, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def cumulative_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score table with true / false positives at ``score >= threshold`` and what the next row adds.

    Columns: ``threshold, pos, neg, tp, fp, n_pos, n_neg, next_pos, next_neg``;
    ``next_*`` is null on the last row of a group.
    """
    cut = even_buckets(scored, "score", "__b")
    buckets = cut.groupBy(*by, "__b").agg(
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
        F.max_by("pos", "score").alias("__first_p"),
        F.max_by("neg", "score").alias("__first_n"),
    )
    group = Window.partitionBy(*by)
    down = group.orderBy(F.col("__b").desc())
    earlier = down.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *by,
        "__b",
        F.coalesce(F.sum("__p").over(earlier), F.lit(0)).alias("__tp0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__fp0"),
        F.sum("__p").over(group).alias("n_pos"),
        F.sum("__n").over(group).alias("n_neg"),
        F.lead("__first_p").over(down).alias("__lead_p"),
        F.lead("__first_n").over(down).alias("__lead_n"),
    )
    inside = Window.partitionBy(*by, "__b").orderBy(F.col("score").desc())
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.select(
        *by,
        "__b",
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        F.sum("pos").over(so_far).alias("__tp"),
        F.sum("neg").over(so_far).alias("__fp"),
        F.lead("pos").over(inside).alias("__np"),
        F.lead("neg").over(inside).alias("__nn"),
    )
    # Both sides use one set of cuts; should they ever not, a bucket finds no offset and the job fails.
    lost = F.raise_error(F.lit("buckets of the scores differ between two uses")).cast("bigint")
    placed = lookup(rows, offsets, [*by, "__b"], how="left")
    return placed.select(
        *by,
        "threshold",
        "pos",
        "neg",
        (F.col("__tp") + F.coalesce("__tp0", lost)).alias("tp"),
        (F.col("__fp") + F.col("__fp0")).alias("fp"),
        "n_pos",
        "n_neg",
        F.coalesce("__np", "__lead_p").alias("next_pos"),
        F.coalesce("__nn", "__lead_n").alias("next_neg"),
    )


def auroc_from_scores(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of a score table; null when a group has one class only.

    A positive counts the negatives below it, ties half.  The part inside a bucket
    and the part from lower buckets are added, so no join is needed.
    """
    cut = even_buckets(scored, "score", "__b")
    below = Window.partitionBy(*by, "__b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(below), F.lit(0))
    area = F.col("pos").cast("double") * (lower + F.col("neg") / 2)
    buckets = cut.select(*by, "__b", "pos", "neg", area.alias("area")).groupBy(*by, "__b").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("area").alias("area")
    )
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("area") + F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(before), F.lit(0))
    sums = buckets.select(*by, "pos", "neg", whole.alias("area")).groupBy(*by).agg(
        F.sum("area").alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select(*by, "n_pos", "n_neg", F.when(both, F.col("area") / pairs).alias("auroc"))


def auroc(
    preds: DataFrame, by: Sequence[str] = (), score: str = "prob_1", positive: str = "label", weight: str | None = None
) -> DataFrame:
    """Binary AUROC per group."""
    return auroc_from_scores(score_table(preds, by, score, positive, weight), by)


def auroc_per_class(preds: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUROC of every class; null when the class is absent (or alone)."""
    rows = class_rows(preds, n_classes, by)
    return auroc(rows, [*by, "class_id"], "score", "positive")


def auroc_macro(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over classes, null unless every class has a value."""
    complete = F.count("auroc") == F.count(F.lit(1))
    return per_class.groupBy(*by).agg(F.when(complete, F.avg("auroc")).alias("auroc_macro"))


# --- curves -----------------------------------------------------------------


def _roc_rows(scored: DataFrame, by: Sequence[str], drop_collinear: bool) -> DataFrame:
    rows = cumulative_counts(scored, by)
    if drop_collinear:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        same_step = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        rows = rows.filter(first | F.col("next_pos").isNull() | ~same_step)
    return rows.select(*by, "threshold", "tp", "fp", "n_pos", "n_neg")


def roc_from_scores(scored: DataFrame, by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """ROC points from the origin (threshold infinity) down; points on a straight line can be dropped.

    The drop rule is the usual one: the origin, the first and the last point stay, a
    point in between goes when the step to it equals the step after it.
    """
    rows = _roc_rows(scored, by, drop_collinear)
    totals = scored.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    origin = totals.select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
        "n_pos",
        "n_neg",
    )
    points = origin.unionByName(rows)
    return points.select(
        "*",
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).alias("tpr"),
        F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg")).alias("fpr"),
    )


def roc_curve(
    preds: DataFrame,
    by: Sequence[str] = (),
    score: str = "prob_1",
    positive: str = "label",
    drop_collinear: bool = True,
) -> DataFrame:
    return roc_from_scores(score_table(preds, by, score, positive), by, drop_collinear)


def pr_curve(
    preds: DataFrame, by: Sequence[str] = (), score: str = "prob_1", positive: str = "label"
) -> DataFrame:
    """Precision and recall per distinct score, closed by the point (precision 1, recall 0) without threshold."""
    scored = score_table(preds, by, score, positive)
    rows = cumulative_counts(scored, by).filter("n_pos > 0")
    points = rows.select(
        *by,
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("n_pos")).alias("recall"),
    )
    end = scored.groupBy(*by).agg(F.sum("pos").alias("n_pos")).filter("n_pos > 0")
    last = end.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(last)


def average_precision(
    preds: DataFrame, by: Sequence[str] = (), score: str = "prob_1", positive: str = "label"
) -> DataFrame:
    """Precision summed over recall steps; groups without positives are left out."""
    rows = cumulative_counts(score_table(preds, by, score, positive), by).filter("n_pos > 0")
    step = F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return rows.groupBy(*by).agg(F.sum(step).alias("average_precision"))


# --- operating points -------------------------------------------------------


def _point(*more: Column) -> Column:
    return F.struct(F.col("threshold"), F.col("sensitivity"), F.col("specificity"), F.col("tp"), F.col("fp"), *more)


def _with_rates(roc: DataFrame) -> DataFrame:
    return roc.withColumn("sensitivity", F.col("tpr")).withColumn("specificity", F.lit(1.0) - F.col("fpr"))


def threshold_for_target(roc: DataFrame, metric: str = "sensitivity", target: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Among points that reach the target, the best other rate; a null row with a note if none does."""
    if metric not in ("sensitivity", "specificity"):
        raise ValueError(f"metric must be 'sensitivity' or 'specificity', got '{metric}'")
    other = "specificity" if metric == "sensitivity" else "sensitivity"
    order = F.when(F.col(metric) >= target, F.struct(F.col(other), F.col("threshold")))
    best = _with_rates(roc).groupBy(*by).agg(F.max_by(_point(), order).alias("p"))
    note = F.when(F.col("p").isNull(), F.lit(f"cannot reach {metric} >= {target}"))
    return best.select(*by, "p.threshold", "p.sensitivity", "p.specificity", note.alias("note"))


def operating_points_from_roc(roc: DataFrame, by: Sequence[str] = (), target: float = 0.95) -> DataFrame:
    """Youden, balanced and target points in long form, one aggregate over the curve.

    Ties go to the point met first on the way down from the highest threshold.
    """
    rows = _with_rates(roc)
    j = F.col("sensitivity") + F.col("specificity") - F.lit(1.0)
    gap = F.abs(F.col("sensitivity") - F.col("specificity"))
    reach_sens = F.when(F.col("sensitivity") >= target, F.struct(F.col("specificity"), F.col("threshold")))
    reach_spec = F.when(F.col("specificity") >= target, F.struct(F.col("sensitivity"), F.col("threshold")))
    pick = {
        "youdens_j": F.struct(j.alias("a"), F.col("threshold")),
        "balanced": F.struct((-gap).alias("a"), F.col("threshold")),
        "high_sensitivity": reach_sens,
        "high_specificity": reach_spec,
    }
    sums = rows.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        *[F.max_by(_point(), order).alias(name) for name, order in pick.items()],
    )
    entries = [
        F.struct(F.lit(name).alias("point"), F.col(f"{name}.threshold").alias("threshold"),
                 F.col(f"{name}.tp").alias("tp"), F.col(f"{name}.fp").alias("fp"))
        for name in pick
    ]
    long = sums.select(*by, "n_pos", "n_neg", F.inline(F.array(*entries)))
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    unreached = F.col("threshold").isNull()

    def unless_single(col: Column) -> Column:
        return F.when(~single, col)

    return long.select(
        *by,
        "point",
        unless_single(F.col("threshold")).alias("threshold"),
        unless_single(F.col("tp") / F.col("n_pos")).alias("sensitivity"),
        unless_single(F.lit(1.0) - F.col("fp") / F.col("n_neg")).alias("specificity"),
        unless_single(F.col("tp")).alias("tp"),
        unless_single(F.col("fp")).alias("fp"),
        unless_single(F.col("n_pos") - F.col("tp")).alias("fn"),
        unless_single(F.col("n_neg") - F.col("fp")).alias("tn"),
        F.when(single, F.lit("single class")).when(unreached, F.lit("target not reached")).alias("note"),
    )


def operating_points(
    preds: DataFrame, by: Sequence[str] = (), score: str = "prob_1", positive: str = "label", target: float = 0.95
) -> DataFrame:
    return operating_points_from_roc(roc_curve(preds, by, score, positive), by, target)


def operating_points_per_class(preds: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest operating points; classes without both outcomes get a note instead of numbers."""
    return operating_points(class_rows(preds, n_classes, by), [*by, "class_id"], "score", "positive")
