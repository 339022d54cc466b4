from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagstats.functions.keys import uniform
from bagstats.operators import bootstrap as BS
from bagstats.operators import draws as D
from bagstats.operators import weights as W
from bagstats.sources.shared import shared_dir


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2), 0.01, 0.99), 2)
    data = [(i, i // 3, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(data, "slide_id bigint, patient_id bigint, label int, prob_1 double").cache()


def test_draws(preds):
    drawn = BS.resample(preds, "slide_id", 30, 1).groupBy("b").agg(F.sum("n").alias("n")).collect()
    assert len(drawn) == 30 and {r.n for r in drawn} == {300}
    by_patient = BS.resample(preds, "patient_id", 30, 1).groupBy("b").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in by_patient} == {300}  # 100 draws of patients with three slides each


def test_interval_matches_a_local_bootstrap(preds):
    frame = preds.toPandas()
    rng = np.random.default_rng(0)
    hit = ((frame.prob_1 >= 0.5).astype(int) == frame.label).to_numpy()
    local = [hit[rng.integers(0, 300, 300)].mean() for _ in range(2000)]
    for mode in ("exact", "poisson"):
        row = BS.bootstrap_ci(preds, "accuracy", "slide_id", 400, mode=mode).first()
        assert row.point == pytest.approx(hit.mean())
        assert row.se == pytest.approx(np.std(local), rel=0.2)
        assert row.ci_lower == pytest.approx(np.percentile(local, 2.5), abs=0.015)
        assert row.ci_upper == pytest.approx(np.percentile(local, 97.5), abs=0.015)
        assert row.n_valid_bootstrap == 400


def test_repeatable_and_independent_of_partitioning(preds):
    one = BS.bootstrap_ci(preds.repartition(1), unit="patient_id", n_bootstrap=20).orderBy("metric").collect()
    many = BS.bootstrap_ci(preds.repartition(13), unit="patient_id", n_bootstrap=20).orderBy("metric").collect()
    for a, b in zip(one, many, strict=True):
        assert a.metric == b.metric and a.ci_lower == pytest.approx(b.ci_lower) and a.se == pytest.approx(b.se)


def test_few_valid_draws_give_no_interval(preds):
    row = BS.bootstrap_ci(preds.filter("label = 1"), "accuracy", "slide_id", 15).first()
    assert row.n_valid_bootstrap == 0 and row.ci_lower is None and row.se is None


def test_levels_and_fallbacks(preds):
    out = BS.metrics_with_ci(preds, 12)
    assert out.count() == 16 and {r.level for r in out.select("level").distinct().collect()} == {"slide", "patient"}
    alone = BS.metrics_with_ci(preds.drop("patient_id"), 12)
    a = alone.filter("level = 'slide'").drop("level").orderBy("metric").collect()
    assert a == alone.filter("level = 'patient'").drop("level").orderBy("metric").collect()


def test_custom_metric(preds):
    def prevalence(cells, keys):
        share = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)) / F.sum("n")
        return cells.groupBy(*keys).agg(share.alias("value")).withColumn("metric", F.lit("prevalence"))

    row = BS.bootstrap_ci(preds, prevalence, "slide_id", 50).first()
    assert row.metric == "prevalence" and row.ci_lower < row.point < row.ci_upper
    with pytest.raises(ValueError, match="Unknown resampling"):
        BS.resample(preds, "slide_id", 5, mode="other")


def test_poisson_weights(spark):
    keys = spark.range(5000).select(W.unit_key(1, "id").alias("k")).select("k.high", "k.low").toPandas()
    w = W.poisson_weights((keys.high.to_numpy(np.uint64) << np.uint64(32)) | keys.low.to_numpy(np.uint64), 40)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w.T) - np.eye(40)).max() < 0.08  # repeats are independent
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def _auroc(pos, score, weight):
    """Weighted area by all pairs; NaN where a class is missing."""
    p, n = weight * pos, weight * ~pos
    if not p.sum() or not n.sum():
        return np.nan
    beats = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    return (p[:, None] * n[None, :] * beats).sum() / (p.sum() * n.sum())


@pytest.mark.parametrize("scores", ["spread", "ties", "one"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_areas_of_all_repeats(spark, scores, ranges):
    """Weighted areas against all pairs: also where one score fills several ranges, and per group with a null group."""
    rng = np.random.default_rng(7)
    count, repeats = 150, 70
    value = {"spread": rng.random(count), "ties": np.round(rng.random(count), 1), "one": np.full(count, 0.5)}[scores]
    hit = rng.random(count) < 0.4
    fold = [None if k % 3 == 0 else k % 3 for k in range(count)]
    data = [(k, f, float(v), bool(h)) for k, (f, v, h) in enumerate(zip(fold, value, hit, strict=True))]
    rows = spark.createDataFrame(data, "id long, fold int, score double, positive boolean").withColumn("__unit", W.unit_key(3, "id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        found = W.auroc_draws(rows, ["fold"], repeats).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = rows.orderBy("id").select("__unit.high", "__unit.low").toPandas()
    weights = W.poisson_weights((keys.high.to_numpy(np.uint64) << np.uint64(32)) | keys.low.to_numpy(np.uint64), repeats)
    assert len(found) == 3 * repeats
    for f in (None, 1, 2):
        own = np.array([g == f for g in fold])
        mine = found[found.fold.isna() if f is None else found.fold == f].sort_values("b")
        assert mine.b.tolist() == list(range(repeats))
        wanted = [_auroc(hit[own], value[own], weights[own, b].astype(float)) for b in range(repeats)]
        assert mine.auroc.to_numpy(float) == pytest.approx(np.array(wanted), nan_ok=True)


def test_confusion_of_all_repeats(spark, monkeypatch):
    """Arrays per label and prediction against weights added row by row, also when the held sums are passed on early."""
    rng = np.random.default_rng(9)
    data = [(k, int(k % 2), int(a), int(b)) for k, (a, b) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 3, 90), strict=True))]
    rows = spark.createDataFrame(data, "id long, fold int, label int, pred int").withColumn("__unit", W.unit_key(5, "id"))
    keys = rows.orderBy("id").select("__unit.high", "__unit.low").toPandas()
    weights = W.poisson_weights((keys.high.to_numpy(np.uint64) << np.uint64(32)) | keys.low.to_numpy(np.uint64), 25)
    wanted = {}
    for (k, fold, label, pred), w in zip(data, weights, strict=True):
        for b in np.flatnonzero(w):
            wanted[fold, int(b), label, pred] = wanted.get((fold, int(b), label, pred), 0) + int(w[b])
    for held in (W.HELD, 60):
        monkeypatch.setattr(W, "HELD", held)
        found = {(r.fold, r.b, r.label, r.pred): r.n for r in W.confusion_draws(rows.repartition(5), ["fold"], 25).collect()}
        assert found == wanted


def test_no_row_is_multiplied_or_joined(preds):
    """All 2,000 repeats pass through arrays: the plan has no generator before the confusion counts are whole, and no join."""
    rows = BS._rows(preds, "patient_id", [], "prob_1", 2)
    plan = BS._weighted_rows(rows, [], ["accuracy", "auroc"], 2000, 42, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    counts = W.confusion_draws(rows.select("label", "pred", W.unit_key(42, "unit").alias("__unit")), [], 2000)
    lines = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [k for k, line in enumerate(lines) if "Generate" in line]
    added = [k for k, line in enumerate(lines) if "Aggregate" in line]
    assert len(made) == 1 and made[0] < added[0]  # repeats become rows above the only aggregate


@pytest.mark.parametrize("form", ["vector", "columns"])
def test_more_classes(spark, form):
    """Vectors and columns of three classes give the same intervals; the point AUROC is that of one class against the rest."""
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 120)
    probs = rng.random((120, 3)) + 0.8 * np.eye(3)[label]
    probs /= probs.sum(1, keepdims=True)
    data = [(k, int(y), [float(v) for v in p]) for k, (y, p) in enumerate(zip(label, probs, strict=True))]
    rows = spark.createDataFrame(data, "slide_id long, label int, probs array<double>")
    if form == "columns":
        rows = rows.select("slide_id", "label", *[F.col("probs")[c].alias(f"prob_{c}") for c in range(3)])
    for mode in ("poisson", "exact"):
        found = {r.metric: r for r in BS.bootstrap_ci(rows, unit="slide_id", n_bootstrap=60, n_classes=3, mode=mode).collect()}
        areas = [_auroc(label == c, probs[:, c], np.ones(120)) for c in range(3)]
        assert set(found) == set(BS.CI_METRICS)
        assert found["auroc"].point == pytest.approx(np.mean(areas))
        assert found["accuracy"].point == pytest.approx((probs.argmax(1) == label).mean())
        assert all(r.ci_lower < r.point < r.ci_upper and r.n_valid_bootstrap == 60 for r in found.values())
    both = BS.metrics_with_ci(rows, 12, n_classes=3)
    assert both.count() == 16


def test_two_classes_as_a_vector(preds):
    """At one half the threshold takes class 1 and the first maximum class 0; elsewhere both forms agree."""
    preds = preds.filter("prob_1 <> 0.5")
    vector = preds.select("slide_id", "patient_id", "label", F.array(1 - F.col("prob_1"), F.col("prob_1")).alias("probs"))
    one = BS.bootstrap_ci(preds, ["auroc", "kappa"], n_bootstrap=30).orderBy("metric").collect()
    two = BS.bootstrap_ci(vector, ["auroc", "kappa"], n_bootstrap=30).orderBy("metric").collect()
    assert [(r.metric, pytest.approx(r.ci_lower), r.n_valid_bootstrap) for r in one] == [(r.metric, r.ci_lower, r.n_valid_bootstrap) for r in two]


def test_custom_metrics_get_the_same_draws(preds):
    def accuracy(cells, keys):
        hits = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
        return cells.groupBy(*keys).agg((hits / F.sum("n")).alias("value")).withColumn("metric", F.lit("accuracy"))

    own = BS.bootstrap_ci(preds, accuracy, n_bootstrap=40).first()
    named = BS.bootstrap_ci(preds, "accuracy", n_bootstrap=40).first()
    assert own.asDict() == pytest.approx(named.asDict())


@pytest.mark.parametrize("n", [1, 700])
def test_exact_draws_are_counted_as_drawn(spark, n):
    """Each unit's bytes are the number of draws that hit it, per group; a unit that is hit more than 255 times too."""
    data = [(f, k + 1, n) for f in ("a", None) for k in range(n)]
    units = spark.createDataFrame(data, "fold string, unit_no long, n_units long")
    repeats = 3000 if n == 1 else 5
    drawn = units.select("fold", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("b"), "unit_no", "n_units")
    drawn = drawn.select("fold", "b", (F.floor(uniform(8, "b", "unit_no") * F.col("n_units")) + 1).alias("unit_no"))
    wanted = {(r.fold, r.unit_no, r.b): r["count"] for r in drawn.groupBy("fold", "unit_no", "b").count().collect()}
    found = {}
    for r in W.drawn_weights(units, ["fold"], 8, repeats).collect():
        w = W._weights(W.pa.array([bytes(r["__unit"])]), repeats)(slice(0, 1))[0]
        found |= {(r.fold, r.unit_no, b): int(c) for b, c in enumerate(w) if c}
    assert found == wanted
    many = W._weights(W.pa.array([np.array([300, 0, 7], "<u4").tobytes(), bytes([1, 2, 3])]), 3)
    assert many(np.array([1, 0])).tolist() == [[1, 2, 3], [300, 0, 7]]


def test_exact_draws_are_not_rows(preds):
    """No plan of an exact interval holds a row per draw beside a join: those rows had been taken for few and broadcast."""
    rows = BS._rows(preds, "slide_id", [], "prob_1", 2)
    plan = BS._weighted_rows(rows, [], ["accuracy", "auroc"], 2000, 42, 2, "exact")._jdf.queryExecution().optimizedPlan().toString()
    for side in plan.split("Join")[1:]:
        assert "Generate" not in side
    plan = BS.resample(preds, "slide_id", 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_exact_areas_with_ties_and_gaps(spark):
    """Repeats of exact draws against all pairs; null is the lowest score, NaN the highest, and a row without label has no part."""
    rng = np.random.default_rng(3)
    score = [None if k % 11 == 0 else float("nan") if k % 13 == 0 else float(np.round(rng.random(), 1)) for k in range(120)]
    label = [None if k % 17 == 0 else int(rng.random() < 0.5) for k in range(120)]
    data = [(k, y, 1, s) for k, (y, s) in enumerate(zip(label, score, strict=True))]
    rows = spark.createDataFrame(data, "unit long, label int, pred int, score double")
    weights = {r.unit: W._weights(W.pa.array([bytes(r["__unit"])]), 40)(slice(0, 1))[0] for r in BS._drawn_units(rows, [], 6, 40).collect()}
    found = {r.b: r.value for r in BS._weighted_rows(rows, [], ["auroc"], 40, 6, 2, "exact").collect()}
    there = [k for k in range(120) if label[k] is not None]
    value = np.array([-1.0 if score[k] is None else 2.0 if np.isnan(score[k]) else score[k] for k in there])
    hit = np.array([label[k] == 1 for k in there])
    for b in range(40):
        w = np.array([float(weights[k][b]) if k in weights else 0.0 for k in there])
        assert found[b] == pytest.approx(_auroc(hit, value, w))


def test_numbers_hashed_in_a_task_are_those_of_spark(spark):
    """Short and long unit numbers, both sides of each piece."""
    n = 120_010
    wanted = spark.range(1, n + 1).select(F.col("id").alias("unit_no"), F.lit(1234).alias("b"))
    wanted = [r[0] for r in wanted.select("unit_no", (uniform(-8, "b", "unit_no") * 2**32).cast("long").alias("v")).orderBy("unit_no").select("v").collect()]
    found = np.full(n + 1, -1, np.int64)
    for first, numbers in D.drawn_numbers(-8, 1234, n):
        assert (found[first : first + len(numbers)] == -1).all()
        found[first : first + len(numbers)] = numbers
    assert found[1:].tolist() == wanted
    assert [int(c.sum()) for c in D.draw_counts(3, 5, [1, 700, n])] == [1, 700, n]


def test_exact_repeats_of_groups(spark):
    """Counts and areas of each group's repeats against its draws; a score of most rows goes on over many blocks."""
    rng = np.random.default_rng(5)
    data = [(f, f"{f}{k % (n // 2 + 1)}", int(rng.integers(0, 2)), int(rng.integers(0, 2)), 0.5 if k % 3 else float(rng.random())) for f, n in (("a", 60), ("b", 9)) for k in range(n)]
    rows = spark.createDataFrame([*data, (None, "c", 1, 1, 0.1), ("a", None, 1, 1, 0.1)], "fold string, unit string, label int, pred int, score double")
    numbers = {(r.fold, r.unit): r.unit_no for r in BS._numbered_units(rows, ["fold"], 6).collect()}
    keyed = rows.join(BS._numbered_units(rows, ["fold"], 6), ["fold", "unit"])
    scored = keyed.select("fold", "score", (F.col("label") == 1).alias("positive"), "unit_no", "n_units")
    counts, areas = D.exact_repeats(keyed.drop("unit", "score"), scored, ["fold"], ["fold"], 6, 25)
    counts = {(r.fold, r.b, r.label, r.pred): r.n for r in counts.collect()}
    areas = {(r.fold, r.b): r.auroc for r in areas.collect()}
    assert len(areas) == 50
    wanted = {}
    for fold in ("a", "b"):
        own = [r for r in data if r[0] == fold]
        size = sum(f == fold for f, _ in numbers)  # a missing unit is numbered too and stands beside no row
        units = spark.range(size).select((F.col("id") + 1).alias("unit_no"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("b"))
        drawn = units.select("b", (F.floor(uniform(6, "b", "unit_no") * F.lit(size)) + 1).alias("unit_no")).groupBy("b", "unit_no").count().collect()
        times = {(r.b, r.unit_no): r["count"] for r in drawn}
        for b in range(25):
            w = np.array([float(times.get((b, numbers[fold, r[1]]), 0)) for r in own])
            for r, t in zip(own, w, strict=True):
                wanted[fold, b, r[2], r[3]] = wanted.get((fold, b, r[2], r[3]), 0) + t
            area = _auroc(np.array([r[2] == 1 for r in own]), np.array([r[4] for r in own]), w)
            assert areas[fold, b] == (None if np.isnan(area) else pytest.approx(area))
    assert counts == {k: v for k, v in wanted.items() if v}


def test_exact_draws_stay_in_their_task(spark):
    """What an exact interval writes grows with rows and repeats, not with their product."""
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = {p for p in shared.rglob("*.parquet")}
    preds = spark.range(4000).select(F.col("id").alias("slide_id"), (F.col("id") % 2).cast("int").alias("label"), F.rand(3).alias("prob_1"))
    BS.bootstrap_ci(preds, ["accuracy", "auroc"], "slide_id", 2000, mode="exact").collect()
    written = sum(p.stat().st_size for p in shared.rglob("*.parquet") if p not in before)
    assert written < 1_000_000  # 8,000,000 draws
