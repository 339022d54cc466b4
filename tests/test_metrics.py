import numpy as np
import pytest
from helpers import rows
from bagstats.functions.spread import even_buckets
from pyspark.sql import functions as F

from bagstats.operators import calibration as CAL
from bagstats.operators import confusion as CM
from bagstats.operators import ranking as R
from bagstats.operators import scores as SC
from bagstats.operators import summaries as SU


def _binary(spark, labels, scores):
    data = [(i, int(y), float(p)) for i, (y, p) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(data, "slide_id bigint, label int, prob_1 double")


@pytest.fixture(scope="module")
def easy(spark):
    return _binary(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])


@pytest.fixture(scope="module")
def random(spark):
    """Scores with many ties, two of them at the very ends."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.25), 0, 1), 2)
    return y, p, _binary(spark, y, p).cache()


def test_perfect_predictions(spark, easy):
    counts = CM.confusion_counts(easy)
    row = CM.accuracy_suite(counts).first()
    assert (row.accuracy, row.kappa, row.mcc) == (1.0, 1.0, 1.0)
    assert R.auroc(easy).first().auroc == 1.0
    youden = R.operating_points(easy).filter("point = 'youdens_j'").first()
    assert (youden.tp, youden.fp, youden.fn, youden.tn) == (2, 0, 0, 2)


def test_patient_level(spark):
    df = spark.createDataFrame(
        [("a", "p1", 1, 0.4, 0.6), ("b", "p1", 1, 0.2, 0.8), ("c", "p2", 0, 0.9, 0.1)],
        "slide_id string, patient_id string, label int, prob_0 double, prob_1 double",
    )
    got = {r.patient_id: r for r in SC.patient_aggregate(df).collect()}
    assert got["p1"].prob_1 == pytest.approx(0.7) and got["p1"].n_slides == 2 and got["p2"].label == 0
    with pytest.raises(ValueError, match="No probability columns"):
        SC.patient_aggregate(df.drop("prob_0", "prob_1"))


def test_confusion_metrics_by_hand(spark):
    """Three classes, one never predicted, one never true."""
    data = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(1, 3)] + [(2, 0)] * 3
    counts = CM.confusion_counts(spark.createDataFrame(data, "label int, pred int"))
    y, p = np.array(data).T
    n, classes = len(y), [0, 1, 2, 3]
    tp = np.array([((y == c) & (p == c)).sum() for c in classes])
    sup = np.array([(y == c).sum() for c in classes])
    pre = np.array([(p == c).sum() for c in classes])
    precision = np.divide(tp, pre, out=np.zeros(4), where=pre > 0)
    recall = np.divide(tp, sup, out=np.zeros(4), where=sup > 0)
    f1 = 2 * tp / (sup + pre)
    row = CM.overall_scores(counts).first()
    assert row.accuracy == pytest.approx(tp.sum() / n)
    assert row.balanced_accuracy == pytest.approx(recall[sup > 0].mean())
    chance = (sup * pre).sum() / n**2
    assert row.kappa == pytest.approx((tp.sum() / n - chance) / (1 - chance))
    mcc = (tp.sum() * n - (sup * pre).sum()) / np.sqrt((n**2 - (pre**2).sum()) * (n**2 - (sup**2).sum()))
    assert row.mcc == pytest.approx(mcc)
    assert row.precision_macro == pytest.approx(precision.mean())
    assert row.f1_weighted == pytest.approx((f1 * sup).sum() / n)
    got = {r.class_id: r for r in CM.class_scores(CM.per_class(counts)).collect()}
    assert [got[c].recall for c in classes] == pytest.approx(list(recall))
    tn = n - sup - pre + tp
    assert [got[c].specificity for c in classes] == pytest.approx(list(tn / (n - sup)))


def test_confusion_grid_keeps_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "label int, pred int")
    grid = CM.confusion_matrix(df, 3, normalize=True)
    assert grid.count() == 9
    assert rows(grid.filter("n > 0").select("label", "pred", "row_share")) == [(0, 0, 0.5), (0, 2, 0.5)]


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auroc_with_ties(random):
    y, p, df = random
    assert R.auroc(df).first().auroc == pytest.approx(_auc(y, p))
    many = R.auroc(df.repartition(17)).first().auroc
    assert many == R.auroc(df.repartition(1)).first().auroc
    flat = df.withColumn("prob_1", F.lit(0.3))
    assert R.auroc(flat).first().auroc == 0.5
    assert R.auroc(df.filter("label = 1")).first().auroc is None


def _roc(y, p):
    """Cumulative counts per distinct score, descending, with straight-line points removed."""
    scores = np.unique(p)[::-1]
    pos = np.array([((p == s) & (y == 1)).sum() for s in scores])
    neg = np.array([((p == s) & (y == 0)).sum() for s in scores])
    tp, fp = pos.cumsum(), neg.cumsum()
    keep = [0] + [i for i in range(1, len(scores) - 1) if pos[i + 1] != pos[i] or neg[i + 1] != neg[i]] + [len(scores) - 1]
    points = [(np.inf, 0, 0)] + [(scores[i], tp[i], fp[i]) for i in keep]
    return points, (scores, pos, tp, fp)


def test_roc_and_pr_curves(random):
    y, p, df = random
    points, (scores, pos, tp, fp) = _roc(y, p)
    got = [(r.threshold, r.tp, r.fp) for r in R.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert got == points
    full = R.roc_curve(df, drop_collinear=False).count()
    assert full == len(scores) + 1
    pr = R.pr_curve(df).filter("threshold is not null").orderBy(F.desc("threshold")).collect()
    assert [r.precision for r in pr] == pytest.approx(list(tp / (tp + fp)))
    assert rows(R.pr_curve(df).filter("threshold is null").select("precision", "recall")) == [(1.0, 0.0)]
    ap = (pos / y.sum() * tp / (tp + fp)).sum()
    assert R.average_precision(df).first()[0] == pytest.approx(ap)


def test_operating_points(random):
    y, p, df = random
    points, _ = _roc(y, p)
    sens = np.array([t / y.sum() for _, t, _ in points])
    spec = 1 - np.array([f / (1 - y).sum() for _, _, f in points])
    got = {r.point: r for r in R.operating_points(df).collect()}
    assert got["youdens_j"].threshold == points[int(np.argmax(sens + spec - 1))][0]
    assert got["balanced"].threshold == points[int(np.argmin(np.abs(sens - spec)))][0]
    valid = np.where(sens >= 0.95)[0]
    assert got["high_sensitivity"].threshold == points[valid[np.argmax(spec[valid])]][0]
    assert got["high_sensitivity"].tp + got["high_sensitivity"].fn == y.sum()


def test_target_out_of_reach_and_single_class(spark, random):
    _, _, df = random
    row = R.threshold_for_target(R.roc_curve(df), "sensitivity", 1.5).first()
    assert row.threshold is None and "cannot reach" in row.note
    one = R.operating_points(df.filter("label = 1")).collect()
    assert {r.note for r in one} == {"single class"} and all(r.tp is None for r in one)


def test_per_class_operating_points_mark_absent_classes(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.3, 0.6, 0.1])], "label int, probs array<double>")
    got = R.operating_points_per_class(df, 3)
    assert {r.note for r in got.filter("class_id = 2").collect()} == {"single class"}
    assert R.auroc_macro(R.auroc_per_class(df, 3)).first()[0] is None


def test_losses(spark):
    rng = np.random.default_rng(2)
    z, y = rng.normal(0, 2, (50, 3)), rng.integers(0, 3, 50)
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, z, strict=True)], "label int, logits array<double>")
    ce = np.log(np.exp(z).sum(1)) - z[np.arange(50), y]
    w = np.array([1.0, 2.0, 0.5])
    assert CM.loss_report(df, "ce").first()[0] == pytest.approx(ce.mean())
    assert CM.loss_report(df, "ce", list(w)).first()[0] == pytest.approx((w[y] * ce).sum() / w[y].sum())
    weighted = w[y] * ce
    assert CM.loss_report(df, "focal", list(w)).first()[0] == pytest.approx(((1 - np.exp(-weighted)) ** 2 * weighted).mean())
    one = spark.createDataFrame([(1, [2.0]), (0, [200.0])], "label int, logits array<double>")
    assert CM.loss_report(one, "bce", [1.0, 3.0]).first()[0] == pytest.approx((3 * np.log1p(np.exp(-2)) + 100) / 2)
    with pytest.raises(Exception, match="single logit"):
        CM.loss_report(df, "bce").collect()
    with pytest.raises(ValueError, match="Unknown loss"):
        CM.loss_report(df, "other")


def test_log_loss_of_impossible_event(spark):
    df = _binary(spark, [1], [0.0])
    assert CM.log_loss(df).first()[0] == pytest.approx(-np.log(CM.DOUBLE_EPSILON))


def test_calibration(spark, random):
    y, p, df = random
    conf, correct = np.maximum(p, 1 - p), ((p > 1 - p).astype(int) == y).astype(float)
    edges = np.linspace(0, 1, 11)
    bins = CAL.calibration_bins(df).orderBy("bin").collect()
    assert len(bins) == 10 and bins[0]["count"] == 0 and bins[0].gap is None
    total = 0.0
    for i, b in enumerate(bins):
        mask = (conf >= edges[i]) & ((conf < edges[i + 1]) | ((i == 9) & (conf <= 1)))
        assert b["count"] == mask.sum() and b.bin_lower == edges[i]
        if mask.any():
            total += abs(conf[mask].mean() - correct[mask].mean()) * mask.mean()
    assert CAL.ece(CAL.calibration_bins(df)).first()[0] == pytest.approx(total)
    assert CAL.brier(df).first()[0] == pytest.approx(((p - y) ** 2).mean())
    two = df.withColumn("prob_0", 1 - F.col("prob_1"))
    assert CAL.brier_multiclass(two).first()[0] == pytest.approx(2 * ((p - y) ** 2).mean())


def test_bins_at_their_edges(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.7, 0.7000000000000001, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "confidence double")
    edges = np.linspace(0, 1, 11)
    want = [min(int(np.searchsorted(edges, v, side="right")) - 1, 9) for v in values]
    assert [r.bin for r in CAL.bin_confidence(df).collect()] == want


def test_threshold_stability(random):
    y, p, df = random
    got = {round(r.delta, 2): r for r in CAL.threshold_stability(df, 0.5).collect()}
    assert len(got) == 9
    for delta, row in got.items():
        t = min(max(0.5 + delta, 0.0), 1.0)
        assert row.tp == ((p >= t) & (y == 1)).sum() and row.fp == ((p >= t) & (y == 0)).sum()
    change = max(abs(got[d].sensitivity - got[0.0].sensitivity) for d in (0.01, -0.01))
    assert got[0.0].max_sens_change_01 == pytest.approx(change)
    assert got[0.0].stability_grade == ("A" if change <= 0.02 else "B" if change <= 0.05 else "C" if change <= 0.1 else "D")
    clamped = {round(r.delta, 2): r.threshold for r in CAL.threshold_stability(df, 0.98).collect()}
    assert clamped[0.05] == 1.0 and clamped[0.1] == 1.0 and len(clamped) == 9


def test_suites(spark, random):
    y, p, df = random
    rows_ = df.withColumn("fold", (F.col("slide_id") % 2).cast("int")).withColumn("patient_id", F.col("slide_id") % 40)
    out = SU.per_fold_and_pooled(rows_).cache()
    pooled = {r.metric: r.value for r in out.filter("scope = 'pooled' and level = 'slide' and class_id is null").collect()}
    assert pooled["n_samples"] == 400 and pooled["auroc_macro"] == pytest.approx(_auc(y, p))
    assert pooled["accuracy"] == pytest.approx(((p >= 0.5).astype(int) == y).mean())
    assert out.filter("level = 'patient' and metric = 'n_samples' and scope = 'pooled'").first().value == 40
    summary = SU.fold_metric_summary(out.filter("scope <> 'pooled' and class_id is null"), ["level", "metric"])
    assert summary.filter("metric = 'accuracy' and level = 'slide'").first().n_folds == 2


def test_fold_choices(spark):
    df = spark.createDataFrame(
        [(0, "loss", 0.5, 4), (1, "loss", 0.3, 8), (2, "loss", 0.3, None), (3, "loss", float("nan"), 0)],
        "fold int, metric string, value double, best_epoch int",
    )
    assert SU.best_fold(df, "loss").first().fold == 1
    assert SU.best_fold(df, "loss", "max").first().fold == 0
    assert [SU.refit_epochs(df, r).first().epochs for r in SU.EPOCH_RULES] == [7, 6, 8, 6]
    assert SU.refit_epochs(df.filter("fold > 1")).first().epochs == 30
    row = SU.fold_metric_summary(df).first()
    assert row.n_folds == 3 and row["min"] == 0.3 and row["std"] == pytest.approx(np.std([0.5, 0.3, 0.3]))


def test_ensemble_needs_every_model(spark):
    df = spark.createDataFrame([("a", 0, 1, 0.2), ("a", 1, 1, 0.4), ("b", 0, 0, 0.1)], "slide_id string, model int, label int, prob_1 double")
    got = {r.slide_id: r.prob_1 for r in SC.ensemble_average(df).collect()}
    assert got["a"] == pytest.approx(0.3)
    with pytest.raises(Exception, match="expected 2 models"):
        SC.ensemble_average(df, 2).collect()


def test_phase_shares(spark):
    summary = spark.createDataFrame([("load", 5.0), ("forward", 3.0), ("step", 12.0), ("idle", None)], "phase string, mean_ms double")
    rows = {r.phase: r for r in SU.phase_shares(summary, "step", "backward").collect()}
    assert {k: (r.mean_ms, r.place, r.slowest) for k, r in rows.items()} == {
        "load": (5.0, 1, True), "backward": (4.0, 2, False), "forward": (3.0, 3, False)
    }
    assert sum(r.share for r in SU.phase_shares(summary).collect()) == pytest.approx(1.0)
    assert SU.phase_shares(summary.filter("false"), "step").count() == 0


def _narrow(spark, scores, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, len(scores))
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, scores, strict=True)], "label int, prob_1 double"), y


@pytest.mark.parametrize("shape", ["narrow", "logits", "two heaps"])
def test_buckets_follow_the_scores(spark, shape):
    """Scores within 1e-9, logits far outside (0, 1), and two heaps: the same areas, and buckets of about equal size."""
    rng = np.random.default_rng(1)
    scores = {"narrow": 0.5 + 1e-9 * rng.permutation(3000) / 3000, "logits": 40 * rng.normal(size=3000), "two heaps": np.where(rng.random(3000) < 0.5, 1e-12, 1.0) * rng.random(3000)}[shape]
    df, y = _narrow(spark, scores)
    assert R.auroc(df).first().auroc == pytest.approx(_auc(y, scores))
    curve = R.cumulative_counts(R.score_table(df)).orderBy(F.desc("threshold")).collect()
    order = np.argsort(-scores)
    assert [r.tp for r in curve] == np.cumsum(y[order]).tolist() and [r.fp for r in curve] == np.cumsum(1 - y[order]).tolist()
    sizes = even_buckets(R.score_table(df), "score", "b").groupBy("b").count().toPandas()["count"]
    assert len(sizes) >= 14 and sizes.max() < 3 * 3000 / 16


def test_rows_that_cannot_be_ranked_are_refused(spark):
    """A null or NaN score, a missing label and a label of -1 fail every metric of the order."""
    for bad in ((1, None), (0, float("nan")), (None, 0.5), (-1, 0.5), (2, 0.5)):
        df = spark.createDataFrame([(1, 0.3), (0, 0.2), bad], "label int, prob_1 double")
        for metric in (R.auroc, R.roc_curve, R.average_precision, lambda d: R.auroc_per_class(d, 2)):
            with pytest.raises(Exception, match="cannot rank|outside 2 classes"):
                metric(df).collect()
    assert R.auroc(spark.createDataFrame([], "label int, prob_1 double")).first().auroc is None
