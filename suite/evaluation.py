"""Metrics, curves, calibration, thresholds, intervals and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagstats.operators import bootstrap as BS
from bagstats.operators import calibration as CAL
from bagstats.operators import confusion as CM
from bagstats.operators import ranking as R
from bagstats.operators import scores as SC
from bagstats.operators import summaries as SU
from bagstats.operators import weights as WT
from suite import views as V
from suite.sql import key, uniform, with_views

N_MULTI = 10
ALL_REPEATS = 2000  # the operators' default


def confusion(spark, sf):
    return V.rounded(CM.confusion_matrix(V.predictions(spark, sf), 2, ["fold"], normalize=True))


def confusion_multi(spark, sf):
    return CM.confusion_matrix(V.predictions_multi(spark, sf), N_MULTI)


def accuracy(spark, sf):
    return V.rounded(CM.accuracy_suite(CM.confusion_counts(V.predictions(spark, sf), ["fold"]), ["fold"]))


def accuracy_multi(spark, sf):
    return V.rounded(CM.accuracy_suite(CM.confusion_counts(V.predictions_multi(spark, sf))))


def prf(spark, sf):
    return V.rounded(CM.prf_suite(CM.confusion_counts(V.predictions(spark, sf), ["fold"]), ["fold"]))


def prf_classes(spark, sf):
    return V.rounded(CM.prf_per_class(CM.confusion_counts(V.predictions_multi(spark, sf))))


def specificity(spark, sf):
    return V.rounded(CM.specificity_per_class(CM.confusion_counts(V.predictions_multi(spark, sf))))


def logloss(spark, sf):
    return V.rounded(CM.log_loss(V.predictions(spark, sf), ["fold"]))


def logloss_multi(spark, sf):
    return V.rounded(CM.log_loss(V.predictions_multi(spark, sf)))


def area(spark, sf):
    return V.rounded(R.auroc(V.predictions(spark, sf), ["fold"]), 9)


def area_total(spark, sf):
    return V.rounded(R.auroc(V.predictions(spark, sf)), 9)


def area_classes(spark, sf):
    return V.rounded(R.auroc_per_class(V.predictions_multi(spark, sf), N_MULTI), 9)


def area_macro(spark, sf):
    return V.rounded(R.auroc_macro(R.auroc_per_class(V.predictions_multi(spark, sf), N_MULTI)), 9)


def patients(spark, sf):
    return V.rounded(SC.patient_aggregate(V.predictions(spark, sf)))


def crops(spark, sf):
    preds = V.predictions(spark, sf).select(F.col("patient_id").alias("slide_id"), F.lit(1).alias("label"), "prob_1")
    return V.rounded(SC.crop_average(preds))


def ensemble(spark, sf):
    """Each user's events of five types stand for the outputs of five models."""
    events = V.table(spark, sf, "events")
    preds = events.select(
        F.col("user_id").alias("slide_id"), F.col("event_type").alias("model"), F.lit(0).alias("label"), (F.col("value") / (F.col("value") + F.lit(50.0))).alias("prob_1")
    )
    return V.rounded(SC.ensemble_average(preds))


def averaged(spark, sf):
    base = V.predictions(spark, sf).select("slide_id", "label", "prob_1")
    other = base.withColumn("prob_1", F.col("prob_1") * F.col("prob_1"))
    return V.rounded(SC.average_probs([base, other]).select("slide_id", "label", "prob_1"))


def brier(spark, sf):
    return V.rounded(CAL.brier(V.predictions(spark, sf), ["fold"]))


def brier_multi(spark, sf):
    return V.rounded(CAL.brier_multiclass(V.predictions_multi(spark, sf)))


def brier_classes(spark, sf):
    return V.rounded(CAL.brier_per_class(V.predictions_multi(spark, sf), N_MULTI))


def bins(spark, sf):
    return V.rounded(CAL.calibration_bins(V.predictions(spark, sf), 10, ["fold"]))


def ece(spark, sf):
    return V.rounded(CAL.ece(CAL.calibration_bins(V.predictions(spark, sf), 10, ["fold"]), ["fold"]))


def bin_of(spark, sf):
    return CAL.bin_confidence(V.predictions(spark, sf).select("slide_id", F.col("prob_1").alias("confidence")), 10).select("slide_id", "bin")


def roc(spark, sf):
    return R.roc_curve(V.predictions(spark, sf), ["fold"]).select(
        "fold", F.round("threshold", 9).alias("threshold"), "tp", "fp", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr")
    )


def roc_total(spark, sf):
    return R.roc_curve(V.predictions(spark, sf)).select(F.round("threshold", 9).alias("threshold"), "tp", "fp")


def precision_recall(spark, sf):
    return V.rounded(R.pr_curve(V.predictions(spark, sf), ["fold"]), 9)


def average_precision(spark, sf):
    return V.rounded(R.average_precision(V.predictions(spark, sf), ["fold"]))


def average_precision_classes(spark, sf):
    rows = SC.class_rows(V.predictions_multi(spark, sf), N_MULTI)
    return V.rounded(R.average_precision(rows, ["class_id"], "score", "positive"))


def running(spark, sf):
    out = R.cumulative_counts(R.score_table(V.predictions(spark, sf)))
    return out.select(F.round("threshold", 9).alias("threshold"), "pos", "neg", "tp", "fp")


def points(spark, sf):
    return V.rounded(R.operating_points(V.predictions(spark, sf), ["fold"]))


def points_classes(spark, sf):
    return V.rounded(R.operating_points_per_class(V.predictions_multi(spark, sf), N_MULTI))


def target(spark, sf):
    return V.rounded(R.threshold_for_target(R.roc_curve(V.predictions(spark, sf), ["fold"]), "specificity", 0.9, ["fold"]))


def thresholds(spark, sf):
    return V.rounded(CAL.at_thresholds(V.predictions(spark, sf), [i / 20 for i in range(1, 20)], ["fold"]))


def stability(spark, sf):
    return V.rounded(CAL.threshold_stability(V.predictions(spark, sf), 0.3, by=["fold"]))


def suite(spark, sf):
    return V.rounded(SU.metrics_suite(V.predictions(spark, sf), 2, ["fold"]))


def suite_multi(spark, sf):
    return V.rounded(SU.metrics_suite(V.predictions_multi(spark, sf), N_MULTI))


def pooled(spark, sf):
    return V.rounded(SU.per_fold_and_pooled(V.predictions(spark, sf)))


def _fold_metrics(spark, sf):
    """Long fold metrics of the real predictions; the best epoch of a fold is made from its counts."""
    wide = CM.accuracy_suite(CM.confusion_counts(V.predictions(spark, sf), ["fold"]), ["fold"])
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy", "kappa")]
    )
    long = wide.select("fold", "n", F.inline(entries))
    undefined = (F.col("fold") == 3) & (F.col("metric") == "kappa")
    return long.select(
        "fold",
        "metric",
        F.when(undefined, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        (F.col("n") % 40 + F.col("fold") * 3 - 1).cast("int").alias("best_epoch"),
    )


def fold_summary(spark, sf):
    return V.rounded(SU.fold_metric_summary(_fold_metrics(spark, sf)))


def best_fold(spark, sf):
    return V.rounded(SU.best_fold(_fold_metrics(spark, sf), "balanced_accuracy", "max"))


def epochs(spark, sf):
    rows = _fold_metrics(spark, sf).filter("metric = 'accuracy'")
    out = None
    for name in SU.EPOCH_RULES:
        one = SU.refit_epochs(rows, name)
        out = one if out is None else out.unionByName(one)
    return out


def loss(spark, sf):
    """Cross-entropy, weighted cross-entropy and focal loss of ten-class logits."""
    rows = V.predictions_multi(spark, sf).withColumn("logits", F.transform("probs", lambda p: p * 20 - 1))
    class_w = [1.0 + 0.1 * c for c in range(N_MULTI)]
    parts = [
        CM.loss_report(rows, "ce").withColumn("kind", F.lit("ce")),
        CM.loss_report(rows, "ce", class_w).withColumn("kind", F.lit("ce_weighted")),
        CM.loss_report(rows, "focal", class_w, 2.0).withColumn("kind", F.lit("focal")),
    ]
    return V.rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def loss_binary(spark, sf):
    rows = V.predictions(spark, sf).withColumn("logits", F.array(F.col("prob_1") * 8 - 3))
    return V.rounded(CM.loss_report(rows, "bce", [1.0, 2.5], by=["fold"]))


def bootstrap(spark, sf):
    """Patients drawn with replacement, all their slides follow."""
    return V.rounded(BS.bootstrap_ci(V.predictions(spark, sf), unit="patient_id"))


def bootstrap_poisson(spark, sf):
    """Slides drawn."""
    return V.rounded(BS.bootstrap_ci(V.predictions(spark, sf), unit="slide_id", mode="poisson"))


def bootstrap_multi(spark, sf):
    """Ten classes as vectors: the AUROC is the mean of one class against the rest."""
    return V.rounded(BS.bootstrap_ci(V.predictions_multi(spark, sf), unit="slide_id", n_classes=10))


def _share_above(cells, keys):
    """A custom metric: share of positives among the scores above one half."""
    above = F.when(F.col("score") > 0.5, F.col("n"))
    hits = F.sum(F.when(F.col("label") == 1, above))
    return cells.groupBy(*keys).agg((F.coalesce(hits, F.lit(0)) / F.sum(above)).alias("value")).withColumn("metric", F.lit("share_above"))


def bootstrap_custom(spark, sf):
    return V.rounded(BS.bootstrap_ci(V.predictions(spark, sf), _share_above, unit="patient_id", n_bootstrap=200))


def with_ci(spark, sf):
    """Slide and patient level."""
    return V.rounded(BS.metrics_with_ci(V.predictions(spark, sf)))


def bootstrap_default(spark, sf):
    """As many draws as the operator makes by itself, n of n patients in each."""
    return V.rounded(BS.bootstrap_ci(V.predictions(spark, sf), unit="patient_id", mode="exact"))


def bootstrap_poisson_default(spark, sf):
    return V.rounded(BS.bootstrap_ci(V.predictions(spark, sf), unit="patient_id", mode="poisson"))


def with_ci_default(spark, sf):
    """As many draws as the operator makes by itself, one for each slide or patient in each."""
    return V.rounded(BS.metrics_with_ci(V.predictions(spark, sf), mode="exact"))


def timing(spark, sf):
    return V.rounded(SU.timing_summary(V.timings(spark, sf)))


def bottleneck(spark, sf):
    rows = SU.phase_shares(SU.timing_summary(V.timings(spark, sf)), "purchase")
    return rows.withColumns({"mean_ms": F.round("mean_ms", 6), "share": F.round("share", 9)})


QUERIES = {
    "A4_patient_aggregate": patients,
    "A9_confusion_matrix": confusion,
    "A9_confusion_matrix_multi": confusion_multi,
    "A10_accuracy_suite": accuracy,
    "A10_accuracy_suite_multi": accuracy_multi,
    "A11_prf_suite": prf,
    "A11_prf_per_class": prf_classes,
    "A12_specificity_per_class": specificity,
    "A13_log_loss": logloss,
    "A13_log_loss_multi": logloss_multi,
    "A14_auroc": area,
    "A14_auroc_total": area_total,
    "A14_auroc_per_class": area_classes,
    "A14_auroc_macro": area_macro,
    "A15_crop_average": crops,
    "A16_ensemble_average": ensemble,
    "A17_brier": brier,
    "A17_brier_multiclass": brier_multi,
    "A17_brier_per_class": brier_classes,
    "A18_calibration_bins": bins,
    "A18_ece": ece,
    "A19_roc_curve": roc,
    "A19_roc_curve_total": roc_total,
    "A20_pr_curve": precision_recall,
    "A20_average_precision": average_precision,
    "A20_average_precision_per_class": average_precision_classes,
    "A21_operating_points": points,
    "A21_operating_points_per_class": points_classes,
    "A22_threshold_for_target": target,
    "A23_threshold_stability": stability,
    "A24_metrics_suite": suite,
    "A24_metrics_suite_multi": suite_multi,
    "A25_per_fold_and_pooled": pooled,
    "A26_fold_metric_summary": fold_summary,
    "A27_bootstrap_ci": bootstrap,
    "A27_bootstrap_poisson": bootstrap_poisson,
    "A27_bootstrap_multi": bootstrap_multi,
    "A27_bootstrap_custom_metric": bootstrap_custom,
    "A28_metrics_with_ci": with_ci,
    "A27_bootstrap_ci_default": bootstrap_default,
    "A27_bootstrap_poisson_default": bootstrap_poisson_default,
    "A28_metrics_with_ci_default": with_ci_default,
    "A29_best_fold": best_fold,
    "A30_refit_epochs": epochs,
    "A32_loss_report": loss,
    "A32_loss_report_bce": loss_binary,
    "A37_timing_summary": timing,
    "A37_bottleneck": bottleneck,
    "J7_at_thresholds": thresholds,
    "J8_bin_confidence": bin_of,
    "J10_average_probs": averaged,
    "W12_cumulative_counts": running,
}

# --- oracles ----------------------------------------------------------------

# Predictions with their predicted class.
_PB = "pb AS (SELECT *, CAST(CASE WHEN prob_1 >= 0.5::DOUBLE THEN 1 ELSE 0 END AS INT) AS pred FROM v_pred)"
_PM = "pm AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred FROM v_pred_multi)"
_PMC = """
pc AS (SELECT slide_id, label, CAST(c - 1 AS INT) AS class_id, probs[c] AS score, CASE WHEN label = c - 1 THEN 1 ELSE 0 END AS positive
       FROM v_pred_multi, range(1, 11) t(c))"""


def _class_table(source: str, by: str, weight: str = "1") -> str:
    """CTEs ``pcl`` (per class) and ``ov`` (overall) of confusion metrics."""
    pre = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
cc AS (SELECT {pre}label, pred, CAST(sum({weight}) AS BIGINT) AS n FROM {source} GROUP BY ALL),
lg AS (SELECT {pre}label AS class_id, CASE WHEN label = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cc
       UNION ALL SELECT {pre}pred, 0, 0, n FROM cc),
p0 AS (SELECT {pre}class_id, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(support) AS DOUBLE) AS support, CAST(sum(predicted) AS DOUBLE) AS predicted FROM lg GROUP BY ALL),
pcl AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
        2 * tp / (support + predicted) AS f1, sum(support) OVER ({part}) AS total FROM p0),
o0 AS (SELECT {pre}sum(support) AS n, sum(tp) AS hits, count(*) FILTER (support > 0) AS k, sum(support * predicted) AS sp, sum(support * support) AS ss, sum(predicted * predicted) AS pp,
        avg(recall) FILTER (support > 0) AS balanced_accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
        sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted FROM pcl {group}),
ov AS (SELECT *, hits / n AS accuracy, CASE WHEN sp / (n * n) < 1 THEN (hits / n - sp / (n * n)) / (1 - sp / (n * n)) END AS kappa,
        CASE WHEN (n * n - pp) * (n * n - ss) > 0 THEN (hits * n - sp) / sqrt((n * n - pp) * (n * n - ss)) ELSE 0 END AS mcc FROM o0)"""


_PRF = "round(precision_macro, 6) AS precision_macro, round(precision_weighted, 6) AS precision_weighted, round(recall_macro, 6) AS recall_macro, round(recall_weighted, 6) AS recall_weighted, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted"
_ACC = "CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(kappa, 6) AS kappa, round(mcc, 6) AS mcc"
_EPS = "2.220446049250313e-16::DOUBLE"


def _auc(source: str, by: str, score: str = "prob_1", positive: str = "label", weight: str = "1", name: str = "auc") -> str:
    pre = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
{name}_g AS (SELECT {pre}{score} AS score, CAST(sum(CASE WHEN {positive} = 1 THEN {weight} ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN {positive} = 1 THEN 0 ELSE {weight} END) AS BIGINT) AS neg FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_g),
{name} AS (SELECT {pre}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auroc FROM {name}_c {group})"""


def _curve(source: str, by: str, score: str = "prob_1", positive: str = "label") -> str:
    """CTE ``cum``: cumulative counts per distinct score, descending."""
    pre = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    frame = f"({part}ORDER BY score DESC)"
    return f"""
g AS (SELECT {pre}{score} AS score, count(*) FILTER ({positive} = 1) AS pos, count(*) FILTER ({positive} <> 1) AS neg FROM {source} GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER {frame} AS tp, sum(neg) OVER {frame} AS fp, sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg,
        row_number() OVER {frame} AS r, lead(pos) OVER {frame} AS next_pos, lead(neg) OVER {frame} AS next_neg FROM g),
roc AS (SELECT {pre}'inf'::DOUBLE AS threshold, 0 AS tp, 0 AS fp, max(n_pos) AS n_pos, max(n_neg) AS n_neg FROM cum {"GROUP BY " + by if by else ""}
        UNION ALL SELECT {pre}score, tp, fp, n_pos, n_neg FROM cum WHERE r = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg),
rates AS (SELECT *, CASE WHEN n_pos > 0 THEN CAST(tp AS DOUBLE) / n_pos END AS sens, 1.0::DOUBLE - CASE WHEN n_neg > 0 THEN CAST(fp AS DOUBLE) / n_neg END AS spec FROM roc)"""


def _points_sql(by: str) -> str:
    def pick(name: str, where: str, order: str) -> str:
        return f"""SELECT {by}, '{name}' AS point, threshold, tp, fp, n_pos, n_neg FROM rates WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}, threshold DESC) = 1"""

    picks = " UNION ALL ".join(
        [
            pick("youdens_j", "TRUE", "sens + spec - 1.0::DOUBLE DESC"),
            pick("balanced", "TRUE", "abs(sens - spec)"),
            pick("high_sensitivity", "sens >= 0.95::DOUBLE", "spec DESC"),
            pick("high_specificity", "spec >= 0.95::DOUBLE", "sens DESC"),
        ]
    )
    return f"""
SELECT {by}, point, round(threshold, 6) AS threshold, round(CAST(tp AS DOUBLE) / n_pos, 6) AS sensitivity, round(1.0::DOUBLE - CAST(fp AS DOUBLE) / n_neg, 6) AS specificity,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n_pos - tp AS BIGINT) AS fn, CAST(n_neg - fp AS BIGINT) AS tn, CAST(NULL AS VARCHAR) AS note FROM ({picks})"""


def _threshold_table(values: list[float]) -> str:
    rows = ", ".join(f"({v!r}::DOUBLE)" for v in values)
    return f"""
tv AS (SELECT * FROM (VALUES {rows}) t(threshold)),
t0 AS (SELECT fold, threshold, count(*) FILTER (label = 1 AND prob_1 >= threshold) AS tp, count(*) FILTER (label = 0 AND prob_1 >= threshold) AS fp,
              count(*) FILTER (label = 1 AND prob_1 < threshold) AS fn, count(*) FILTER (label = 0 AND prob_1 < threshold) AS tn FROM v_pred, tv GROUP BY 1, 2),
tt AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS npv, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM t0)"""


_RATES = "round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round(accuracy, 6) AS accuracy"
_DELTAS = [0.0, *[s * d for d in CAL.DEFAULT_DELTAS for s in (-1, 1)]]
_SPOTS = {d: max(0.0, min(1.0, 0.3 + d)) for d in _DELTAS}
_DELTA_ROWS = ", ".join(f"({d!r}::DOUBLE, {t!r}::DOUBLE)" for d, t in _SPOTS.items())

_EDGES = CAL.bin_edges(10)
_EDGE_ROWS = ", ".join(f"({i}, {_EDGES[i]!r}::DOUBLE, {_EDGES[i + 1]!r}::DOUBLE)" for i in range(10))
_BINS = f"""
e AS (SELECT CAST(bin AS INT) AS bin, bin_lower, bin_upper FROM (VALUES {_EDGE_ROWS}) t(bin, bin_lower, bin_upper)),
c AS (SELECT fold, greatest(prob_1, 1.0::DOUBLE - prob_1) AS confidence, CASE WHEN (prob_1 > 1.0::DOUBLE - prob_1) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct FROM v_pred),
b AS (SELECT fold, bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM c JOIN e ON confidence >= bin_lower AND (confidence < bin_upper OR (bin = 9 AND confidence <= bin_upper)) GROUP BY 1, 2),
bins AS (SELECT f.fold AS fold, e.bin AS bin, bin_lower, bin_upper, (bin_lower + bin_upper) / 2 AS bin_center, conf AS avg_confidence, acc AS avg_accuracy, coalesce(n, 0) AS "count", abs(conf - acc) AS gap
         FROM (SELECT DISTINCT fold FROM v_pred) f CROSS JOIN e LEFT JOIN b ON b.fold = f.fold AND b.bin = e.bin)"""


def _suite_sql(by: str, extra: str = "") -> str:
    """Long metric rows from ``ov``, ``pcl``, ``ll``, ``auc`` (class 1) and ``auc0`` (class 0)."""
    pre = f"{by}, " if by else ""
    lines = [
        f"SELECT {pre}CAST(NULL AS INT) AS class_id, '{m}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value{extra} FROM ov"
        for m, c in [("n_samples", "n"), *[(m, m) for m in SU._OVERALL]]
    ]
    lines += [
        f"SELECT {pre}CAST(class_id AS INT), '{m}', round({m}, 6){extra} FROM (SELECT *, CASE WHEN total > support THEN (total - support - (predicted - tp)) / (total - support) ELSE 0 END AS specificity FROM pcl)"
        for m in SU._PER_CLASS
    ]
    lines.append(f"SELECT {pre}NULL, 'log_loss', round(log_loss, 6){extra} FROM ll")
    return " UNION ALL ".join(lines)


def _binary_suite(source: str, by: str, extra: str = "") -> str:
    pre = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
px AS (SELECT *, CAST(CASE WHEN prob_1 >= 0.5::DOUBLE THEN 1 ELSE 0 END AS INT) AS pred, 1 - label AS other, 1.0::DOUBLE - prob_1 AS prob_0 FROM {source}),
{_class_table("px", by)},
ll AS (SELECT {pre}avg(-ln(least(greatest(CASE WHEN label = 1 THEN prob_1 ELSE prob_0 END, {_EPS}), 1.0::DOUBLE - {_EPS}))) AS log_loss FROM px {group}),
{_auc("px", by)}, {_auc("px", by, "prob_0", "other", name="auc0")},
suite AS ({_suite_sql(by, extra)}
  UNION ALL SELECT {pre}1, 'auroc', round(auroc, 6){extra} FROM auc UNION ALL SELECT {pre}0, 'auroc', round(auroc, 6){extra} FROM auc0
  UNION ALL SELECT {pre}NULL, 'auroc_macro', round(auroc, 6){extra} FROM auc)"""


_FOLD_METRICS = f"""{_PB}, {_class_table("pb", "fold")},
fm0 AS (SELECT fold, n, 'accuracy' AS metric, accuracy AS value FROM ov UNION ALL SELECT fold, n, 'balanced_accuracy', balanced_accuracy FROM ov UNION ALL SELECT fold, n, 'kappa', kappa FROM ov),
fm AS (SELECT fold, metric, CASE WHEN fold = 3 AND metric = 'kappa' THEN NULL ELSE value END AS value, CAST(CAST(n AS BIGINT) % 40 + fold * 3 - 1 AS INT) AS best_epoch FROM fm0)"""


def _interval_sql(repeats: int) -> str:
    return f"""
ci AS (SELECT metric, count(value) AS n_valid_bootstrap, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, stddev_pop(value) AS se FROM reps GROUP BY 1)
SELECT metric, round(point, 6) AS point, CASE WHEN n_valid_bootstrap >= 10 THEN round(lo, 6) END AS ci_lower, CASE WHEN n_valid_bootstrap >= 10 THEN round(hi, 6) END AS ci_upper,
       CASE WHEN n_valid_bootstrap >= 10 THEN round(se, 6) END AS se, n_valid_bootstrap, CAST({repeats} AS BIGINT) AS n_bootstrap FROM points JOIN ci USING (metric)"""


def _boot_metrics(source: str, by: str, name: str, macro: bool = False) -> str:
    """CTE ``name``: long metric values of weighted cells ``source``; with ``macro`` the score is a vector of classes."""
    pre = f"{by}, " if by else ""
    tables = _class_table(source, by, "n").replace("cc AS", f"{name}_cc AS").replace("FROM cc", f"FROM {name}_cc")
    for cte in ("lg", "p0", "pcl", "o0", "ov"):
        tables = tables.replace(f"\n{cte} AS", f"\n{name}_{cte} AS").replace(f"FROM {cte} ", f"FROM {name}_{cte} ").replace(f"FROM {cte})", f"FROM {name}_{cte})")
    rows = " UNION ALL ".join(
        f"SELECT {pre}'{m}' AS metric, CASE WHEN k >= 2 THEN {m} END AS value FROM {name}_ov" for m in BS.CI_METRICS if m != "auroc"
    )
    if macro:
        group = f"GROUP BY {by}" if by else ""
        area = f"""{name}_o AS (SELECT {pre}c AS class_id, CAST(label = c - 1 AS INT) AS hit, score[c] AS score, n FROM {source}, range(1, 11) t(c)),
{_auc(f"{name}_o", f"{pre}class_id", "score", "hit", "n", name=f"{name}_k").strip()},
{name}_a AS (SELECT {pre}CASE WHEN count(auroc) = count(*) THEN avg(auroc) END AS auroc FROM {name}_k {group})"""
    else:
        area = _auc(source, by, "score", "label", "n", name=f"{name}_a").strip()
    return f"""{tables.strip()},
{area},
{name} AS ({rows} UNION ALL SELECT {pre}'auroc', auroc FROM {name}_a)"""


def _weights_sql(repeats: int, seed: int = 42) -> str:
    """CTE ``wt``: unit, b, w of every unit and repeat with a weight."""

    def scrambled(source: str, x: str, name: str) -> str:
        """Three CTEs that end in column ``x`` of ``name``: products of 32-bit numbers fit 64 bits."""
        return f"""
{name}a AS (SELECT unit, b, high, {x} AS x FROM {source}),
{name}b AS (SELECT unit, b, high, (xor(x, x >> 16) * {WT.FIRST}) & 4294967295 AS x FROM {name}a),
{name}c AS (SELECT unit, b, high, (xor(x, x >> 13) * {WT.SECOND}) & 4294967295 AS x FROM {name}b),
{name} AS (SELECT unit, b, high, xor(x, x >> 16) AS x FROM {name}c)"""

    steps = " + ".join(f"CASE WHEN x >= {t} THEN 1 ELSE 0 END" for t in WT.THRESHOLDS)
    halves = [f"CAST('0x' || substr({key(seed, 'unit')}, {start}, 8) AS UBIGINT)" for start in (1, 9)]
    return f"""
ky AS (SELECT unit, {halves[0]} AS high, {halves[1]} AS low FROM (SELECT DISTINCT unit FROM cells)),
x0 AS (SELECT unit, CAST(b AS UBIGINT) AS b, high, (low + ((CAST(b AS UBIGINT) + 1) * {WT.STEP}) & 4294967295) & 4294967295 AS x FROM ky, range({repeats}) t(b)),
{scrambled("x0", "x", "x1").strip()},
{scrambled("x1", "xor(x, high)", "x2").strip()},
wt AS (SELECT * FROM (SELECT unit, b, {steps} AS w FROM x2) WHERE w > 0)"""


def _resampled_sql(source: str, unit: str, repeats: int, mode: str, score: str = "prob_1", pred: str = "") -> str:
    """CTEs ``pt`` (all cells) and ``rs`` (cells of every repeat ``b``)."""
    pred = pred or f"CAST(CASE WHEN {score} >= 0.5::DOUBLE THEN 1 ELSE 0 END AS INT)"
    cells = f"""
cells AS (SELECT {unit} AS unit, label, {pred} AS pred, {score} AS score, count(*) AS n FROM {source} GROUP BY ALL),
pt AS (SELECT label, pred, score, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL)"""
    if mode == "exact":
        drawn = f"""
un AS (SELECT unit, row_number() OVER (ORDER BY {key(42, "unit")}, unit) AS unit_no, count(*) OVER () AS n_units FROM (SELECT DISTINCT unit FROM cells)),
dr AS (SELECT b, CAST(floor({uniform(42, "b", "unit_no")} * n_units) AS BIGINT) + 1 AS unit_no FROM un, range({repeats}) t(b)),
rs AS (SELECT b, label, pred, score, CAST(sum(n) AS BIGINT) AS n FROM dr JOIN un USING (unit_no) JOIN cells USING (unit) GROUP BY ALL)"""
    else:
        drawn = f"""{_weights_sql(repeats)},
rs AS (SELECT b, label, pred, score, CAST(sum(n * w) AS BIGINT) AS n FROM wt JOIN cells USING (unit) GROUP BY ALL)"""
    return f"{cells.strip()}, {drawn.strip()}"


def _bootstrap_sql(source: str, unit: str, repeats: int, mode: str = "exact", macro: bool = False) -> str:
    classes = {"score": "probs", "pred": "CAST(list_position(probs, list_max(probs)) - 1 AS INT)"} if macro else {}
    return f"""{_resampled_sql(source, unit, repeats, mode, **classes)},
{_boot_metrics("pt", "", "pts", macro)}, points AS (SELECT metric, value AS point FROM pts),
{_boot_metrics("rs", "b", "reps", macro)},
{_interval_sql(repeats).strip()}"""


_SHARE_SQL = "sum(CASE WHEN score > 0.5::DOUBLE AND label = 1 THEN n ELSE 0 END) / sum(CASE WHEN score > 0.5::DOUBLE THEN n END)"

_PATIENTS = """pat AS (SELECT patient_id, avg(prob_1) AS prob_1, count(*) AS n_slides, max(lbl) AS label FROM (
  SELECT *, first_value(label) OVER (PARTITION BY patient_id ORDER BY n_label DESC, label) AS lbl FROM (
    SELECT *, count(*) OVER (PARTITION BY patient_id, label) AS n_label FROM v_pred)) GROUP BY 1)"""

_CE = "(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[label + 1])"

ORACLES = {
    "A4_patient_aggregate": with_views("v_pred", f"WITH {_PATIENTS} SELECT patient_id, label, n_slides, round(prob_1, 6) AS prob_1 FROM pat"),
    "A9_confusion_matrix": with_views("v_pred", f"""
WITH {_PB}, g AS (SELECT f.fold AS fold, CAST(a AS INT) AS label, CAST(b AS INT) AS pred FROM (SELECT DISTINCT fold FROM pb) f, range(2) t(a), range(2) s(b)),
n AS (SELECT fold, label, pred, count(*) AS n FROM pb GROUP BY ALL), m AS (SELECT fold, label, pred, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (fold, label, pred))
SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY fold, label) > 0 THEN n / sum(n) OVER (PARTITION BY fold, label) ELSE 0 END, 6) AS row_share FROM m"""),
    "A9_confusion_matrix_multi": with_views("v_pred_multi", f"""
WITH {_PM}, g AS (SELECT CAST(a AS INT) AS label, CAST(b AS INT) AS pred FROM range(10) t(a), range(10) s(b)), n AS (SELECT label, pred, count(*) AS n FROM pm GROUP BY ALL)
SELECT label, pred, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (label, pred)"""),
    "A10_accuracy_suite": with_views("v_pred", f"WITH {_PB}, {_class_table('pb', 'fold')} SELECT fold, {_ACC} FROM ov"),
    "A10_accuracy_suite_multi": with_views("v_pred_multi", f"WITH {_PM}, {_class_table('pm', '')} SELECT {_ACC} FROM ov"),
    "A11_prf_suite": with_views("v_pred", f"WITH {_PB}, {_class_table('pb', 'fold')} SELECT fold, {_PRF} FROM ov"),
    "A11_prf_per_class": with_views("v_pred_multi", f"""
WITH {_PM}, {_class_table('pm', '')} SELECT class_id, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pcl"""),
    "A12_specificity_per_class": with_views("v_pred_multi", f"""
WITH {_PM}, {_class_table('pm', '')} SELECT class_id, round(CASE WHEN total > support THEN (total - support - (predicted - tp)) / (total - support) ELSE 0 END, 6) AS specificity FROM pcl"""),
    "A13_log_loss": with_views("v_pred", f"SELECT fold, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN prob_1 ELSE 1.0::DOUBLE - prob_1 END, {_EPS}), 1.0::DOUBLE - {_EPS}))), 6) AS log_loss FROM v_pred GROUP BY 1"),
    "A13_log_loss_multi": with_views("v_pred_multi", f"SELECT round(avg(-ln(least(greatest(probs[label + 1], {_EPS}), 1.0::DOUBLE - {_EPS}))), 6) AS log_loss FROM v_pred_multi"),
    "A14_auroc": with_views("v_pred", f"WITH {_auc('v_pred', 'fold')} SELECT fold, n_pos, n_neg, round(auroc, 9) AS auroc FROM auc"),
    "A14_auroc_total": with_views("v_pred", f"WITH {_auc('v_pred', '')} SELECT n_pos, n_neg, round(auroc, 9) AS auroc FROM auc"),
    "A14_auroc_per_class": with_views("v_pred_multi", f"WITH {_PMC}, {_auc('pc', 'class_id', 'score', 'positive')} SELECT class_id, n_pos, n_neg, round(auroc, 9) AS auroc FROM auc"),
    "A14_auroc_macro": with_views("v_pred_multi", f"WITH {_PMC}, {_auc('pc', 'class_id', 'score', 'positive')} SELECT CASE WHEN count(auroc) = count(*) THEN round(avg(auroc), 9) END AS auroc_macro FROM auc"),
    "A15_crop_average": with_views("v_pred", "SELECT patient_id AS slide_id, CAST(1 AS INT) AS label, round(avg(prob_1), 6) AS prob_1 FROM v_pred GROUP BY 1"),
    "A16_ensemble_average": """
SELECT user_id AS slide_id, CAST(0 AS INT) AS label, count(DISTINCT event_type) AS n_models, round(avg(value / (value + 50.0::DOUBLE)), 6) AS prob_1 FROM events GROUP BY 1""",
    "A17_brier": with_views("v_pred", "SELECT fold, round(avg((prob_1 - label) * (prob_1 - label)), 6) AS brier FROM v_pred GROUP BY 1"),
    "A17_brier_multiclass": with_views("v_pred_multi", f"WITH {_PMC} SELECT round(avg(s), 6) AS brier_multiclass FROM (SELECT slide_id, sum((score - positive) * (score - positive)) AS s FROM pc GROUP BY 1)"),
    "A17_brier_per_class": with_views("v_pred_multi", f"WITH {_PMC} SELECT class_id, round(avg((score - positive) * (score - positive)), 6) AS brier FROM pc GROUP BY 1"),
    "A18_calibration_bins": with_views("v_pred", f"""
WITH {_BINS} SELECT fold, bin, round(bin_lower, 6) AS bin_lower, round(bin_upper, 6) AS bin_upper, round(bin_center, 6) AS bin_center,
  round(avg_confidence, 6) AS avg_confidence, round(avg_accuracy, 6) AS avg_accuracy, "count", round(gap, 6) AS gap FROM bins"""),
    "A18_ece": with_views("v_pred", f"""WITH {_BINS} SELECT fold, round(sum(coalesce(gap, 0) * "count") / sum("count"), 6) AS ece FROM bins GROUP BY 1"""),
    "A19_roc_curve": with_views("v_pred", f"""
WITH {_curve("v_pred", "fold")} SELECT fold, round(threshold, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / n_pos, 9) AS tpr, round(CAST(fp AS DOUBLE) / n_neg, 9) AS fpr FROM roc"""),
    "A19_roc_curve_total": with_views("v_pred", f"WITH {_curve('v_pred', '')} SELECT round(threshold, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM roc"),
    "A20_pr_curve": with_views("v_pred", f"""
WITH {_curve("v_pred", "fold")} SELECT fold, round(score, 9) AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision, round(CAST(tp AS DOUBLE) / n_pos, 9) AS recall FROM cum
UNION ALL SELECT DISTINCT fold, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM cum"""),
    "A20_average_precision": with_views("v_pred", f"WITH {_curve('v_pred', 'fold')} SELECT fold, round(sum(CAST(pos AS DOUBLE) / n_pos * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS average_precision FROM cum GROUP BY 1"),
    "A20_average_precision_per_class": with_views("v_pred_multi", f"""
WITH {_PMC}, {_curve("pc", "class_id", "score", "positive")} SELECT class_id, round(sum(CAST(pos AS DOUBLE) / n_pos * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS average_precision FROM cum GROUP BY 1"""),
    "A21_operating_points": with_views("v_pred", f"WITH {_curve('v_pred', 'fold')} {_points_sql('fold')}"),
    "A21_operating_points_per_class": with_views("v_pred_multi", f"WITH {_PMC}, {_curve('pc', 'class_id', 'score', 'positive')} {_points_sql('class_id')}"),
    "A22_threshold_for_target": with_views("v_pred", f"""
WITH {_curve("v_pred", "fold")} SELECT fold, round(threshold, 6) AS threshold, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, CAST(NULL AS VARCHAR) AS note
FROM rates WHERE spec >= 0.9::DOUBLE QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sens DESC, threshold DESC) = 1"""),
    "A23_threshold_stability": with_views("v_pred", f"""
WITH {_threshold_table(sorted(set(_SPOTS.values())))}, d AS (SELECT * FROM (VALUES {_DELTA_ROWS}) t(delta, threshold)),
j AS (SELECT * FROM tt JOIN d USING (threshold)), base AS (SELECT fold, sensitivity AS s0, specificity AS c0, ppv AS p0, npv AS n0 FROM j WHERE delta = 0),
ch AS (SELECT j.*, sensitivity - s0 AS sc, specificity - c0 AS cc, ppv - p0 AS pc, npv - n0 AS nc FROM j JOIN base USING (fold)),
mx AS (SELECT *, coalesce(max(abs(sc)) FILTER (delta <> 0 AND abs(delta) <= 0.011) OVER (PARTITION BY fold), 0) AS m1, coalesce(max(abs(sc)) FILTER (delta <> 0 AND abs(delta) <= 0.051) OVER (PARTITION BY fold), 0) AS m5 FROM ch)
SELECT fold, delta, round(threshold, 6) AS threshold, tp, fp, fn, tn, {_RATES}, round(sc, 6) AS sensitivity_change, round(cc, 6) AS specificity_change, round(pc, 6) AS ppv_change, round(nc, 6) AS npv_change,
       round(m1, 6) AS max_sens_change_01, round(m5, 6) AS max_sens_change_05, CASE WHEN m1 <= 0.02 THEN 'A' WHEN m1 <= 0.05 THEN 'B' WHEN m1 <= 0.10 THEN 'C' ELSE 'D' END AS stability_grade FROM mx"""),
    "A24_metrics_suite": with_views("v_pred", f"WITH {_binary_suite('v_pred', 'fold')} SELECT * FROM suite"),
    "A24_metrics_suite_multi": with_views("v_pred_multi", f"""
WITH {_PM}, {_PMC}, {_class_table("pm", "")}, ll AS (SELECT avg(-ln(least(greatest(probs[label + 1], {_EPS}), 1.0::DOUBLE - {_EPS}))) AS log_loss FROM pm),
{_auc("pc", "class_id", "score", "positive")}
{_suite_sql("")} UNION ALL SELECT class_id, 'auroc', round(auroc, 6) FROM auc
UNION ALL SELECT NULL, 'auroc_macro', CASE WHEN count(auroc) = count(*) THEN round(avg(auroc), 6) END FROM auc"""),
    "A25_per_fold_and_pooled": with_views("v_pred", f"""
WITH sl AS (SELECT CAST(fold AS VARCHAR) AS scope, patient_id, label, prob_1 FROM v_pred UNION ALL SELECT 'pooled', patient_id, label, prob_1 FROM v_pred),
lb AS (SELECT scope, patient_id, label FROM sl GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY scope, patient_id ORDER BY count(*) DESC, label) = 1),
mn AS (SELECT scope, patient_id, avg(prob_1) AS prob_1 FROM sl GROUP BY ALL),
lv AS (SELECT 'slide|' || scope AS k, label, prob_1 FROM sl UNION ALL SELECT 'patient|' || scope, label, prob_1 FROM mn JOIN lb USING (scope, patient_id)),
{_binary_suite("lv", "k")} SELECT split_part(k, '|', 1) AS level, split_part(k, '|', 2) AS scope, class_id, metric, value FROM suite"""),
    "A26_fold_metric_summary": with_views("v_pred", f"""
WITH {_FOLD_METRICS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n_folds FROM fm GROUP BY 1"""),
    "A27_bootstrap_ci": with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'patient_id', ALL_REPEATS, 'poisson')}"),
    "A27_bootstrap_poisson": with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'slide_id', ALL_REPEATS, 'poisson')}"),
    "A27_bootstrap_multi": with_views("v_pred_multi", f"WITH {_bootstrap_sql('v_pred_multi', 'slide_id', ALL_REPEATS, 'poisson', True)}"),
    "A27_bootstrap_custom_metric": with_views("v_pred", f"""
WITH {_resampled_sql("v_pred", "patient_id", 200, "poisson")}, points AS (SELECT 'share_above' AS metric, {_SHARE_SQL} AS point FROM pt),
reps AS (SELECT b, 'share_above' AS metric, {_SHARE_SQL} AS value FROM rs GROUP BY b),
{_interval_sql(200).strip()}"""),
    "A28_metrics_with_ci": f"""
SELECT 'slide' AS level, * FROM ({with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'slide_id', ALL_REPEATS, 'poisson')}")})
UNION ALL SELECT 'patient', * FROM ({with_views("v_pred", f"WITH {_PATIENTS}, {_bootstrap_sql('pat', 'patient_id', ALL_REPEATS, 'poisson')}")})""",
    "A27_bootstrap_ci_default": with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'patient_id', ALL_REPEATS)}"),
    "A27_bootstrap_poisson_default": with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'patient_id', ALL_REPEATS, 'poisson')}"),
    "A28_metrics_with_ci_default": f"""
SELECT 'slide' AS level, * FROM ({with_views("v_pred", f"WITH {_bootstrap_sql('v_pred', 'slide_id', ALL_REPEATS)}")})
UNION ALL SELECT 'patient', * FROM ({with_views("v_pred", f"WITH {_PATIENTS}, {_bootstrap_sql('pat', 'patient_id', ALL_REPEATS)}")})""",
    "A29_best_fold": with_views("v_pred", f"""
WITH {_FOLD_METRICS} SELECT metric, fold, round(value, 6) AS value FROM fm WHERE metric = 'balanced_accuracy' ORDER BY value DESC, fold LIMIT 1"""),
    "A30_refit_epochs": with_views("v_pred", f"""
WITH {_FOLD_METRICS}, v AS (SELECT CAST(best_epoch AS DOUBLE) AS e FROM fm WHERE metric = 'accuracy' AND best_epoch > 0),
s AS (SELECT 'p75' AS rule, quantile_cont(e, 0.75) AS q, count(*) AS n FROM v UNION ALL SELECT 'median', quantile_cont(e, 0.5), count(*) FROM v
  UNION ALL SELECT 'max', max(e), count(*) FROM v UNION ALL SELECT 'mean', avg(e), count(*) FROM v)
SELECT rule, CASE WHEN n = 0 THEN 30 ELSE greatest(1, CAST(ceil(round(q, 9)) AS INT)) END AS epochs, n AS n_folds FROM s"""),
    "A32_loss_report": with_views("v_pred_multi", f"""
WITH l AS (SELECT label, list_transform(probs, lambda p: p * 20 - 1) AS z, 1.0::DOUBLE + 0.1::DOUBLE * label AS w FROM v_pred_multi), c AS (SELECT *, {_CE} AS ce FROM l)
SELECT 'ce' AS kind, round(avg(ce), 6) AS loss FROM c UNION ALL SELECT 'ce_weighted', round(sum(w * ce) / sum(w), 6) FROM c
UNION ALL SELECT 'focal', round(avg(pow(1 - exp(-(w * ce)), 2.0) * w * ce), 6) FROM c"""),
    "A32_loss_report_bce": with_views("v_pred", """
WITH z AS (SELECT fold, label, prob_1 * 8 - 3 AS z FROM v_pred)
SELECT fold, round(avg((1 - label) * z + (1 + 1.5 * label) * (ln(1 + exp(-abs(z))) + greatest(-z, 0))), 6) AS loss FROM z GROUP BY 1"""),
    "A37_timing_summary": with_views("v_timing", """
SELECT phase, count(ms) AS n_iters, round(avg(ms), 6) AS mean_ms, round(stddev_pop(ms), 6) AS std_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms,
  round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.1), 6) AS p10_ms, round(quantile_cont(ms, 0.9), 6) AS p90_ms, round(1000.0 / avg(ms), 6) AS items_per_sec FROM v_timing GROUP BY 1"""),
    "A37_bottleneck": with_views("v_timing", """
WITH m AS (SELECT phase, avg(ms) AS mean_ms FROM v_timing GROUP BY 1),
r AS (SELECT 'rest' AS phase, max(mean_ms) FILTER (phase = 'purchase') - coalesce(sum(mean_ms) FILTER (phase <> 'purchase'), 0) AS mean_ms FROM m),
p AS (SELECT * FROM m WHERE phase <> 'purchase' UNION ALL SELECT * FROM r WHERE mean_ms > 0)
SELECT phase, round(mean_ms, 6) AS mean_ms, round(mean_ms / sum(mean_ms) OVER (), 9) AS share,
       CAST(row_number() OVER (ORDER BY mean_ms DESC, phase) AS INT) AS place, row_number() OVER (ORDER BY mean_ms DESC, phase) = 1 AS slowest FROM p"""),
    "J7_at_thresholds": with_views("v_pred", f"WITH {_threshold_table([i / 20 for i in range(1, 20)])} SELECT fold, round(threshold, 6) AS threshold, tp, fp, fn, tn, {_RATES} FROM tt"),
    "J8_bin_confidence": with_views("v_pred", f"""
WITH e AS (SELECT * FROM (VALUES {_EDGE_ROWS}) t(bin, lo, hi)) SELECT slide_id, CAST(bin AS INT) AS bin FROM v_pred JOIN e ON prob_1 >= lo AND (prob_1 < hi OR (bin = 9 AND prob_1 <= hi))"""),
    "J10_average_probs": with_views("v_pred", "SELECT slide_id, label, round((prob_1 + prob_1 * prob_1) / 2, 6) AS prob_1 FROM v_pred"),
    "W12_cumulative_counts": with_views("v_pred", f"WITH {_curve('v_pred', '')} SELECT round(score, 9) AS threshold, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum"),
}
