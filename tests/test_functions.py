import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from bagstats.functions import ids, keys, probs, spread


@pytest.mark.parametrize(
    ("raw", "root", "want"),
    [
        ("case.SVS", None, "case"),
        ("nested\\case.NDPI", None, "nested/case"),
        ("TCGA.case.8923A151", None, "TCGA.case.8923A151"),
        ("features/case.h5", None, "features/case"),
        ("/mounted/slides/case.svs", None, "case"),
        ("/mounted/slides/sub/case.svs", "/mounted/slides", "sub/case"),
        ("/other/case.tiff", "/mounted/slides", "case"),
        (" ./case.h5 ", None, "case"),
        ("case.svs.h5", None, "case.svs"),
    ],
)
def test_normalize_slide_id(spark, raw, root, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(ids.normalize_slide_id("raw", root)).first()[0] == want


def test_paths_round_trip(spark):
    df = spark.createDataFrame([("file:///data/root/a.b/c.x.h5",), ("/data/root/d.h5",)], "p string")
    got = rows(df.select(ids.slide_id_from_path("p", "/data/root")))
    assert got == [("a.b/c.x",), ("d",)]
    back = spark.createDataFrame([("a/b",)], "s string").select(ids.path_from_slide_id("s", "/r")).first()[0]
    assert back == "/r/a/b.h5"


def test_best_epoch(spark):
    df = spark.createDataFrame([("x/best-epoch=5-v.ckpt",), ("epoch=12-step=500.ckpt",), ("last.ckpt",), (None,)], "p string")
    assert [r[0] for r in df.select(ids.parse_best_epoch("p")).collect()] == [6, 13, None, None]


def test_uniform_and_normal_are_plausible(spark):
    df = spark.range(4000).select(keys.uniform(1, "id").alias("u"), keys.normal(1, "id").alias("z")).toPandas()
    assert 0 <= df.u.min() and df.u.max() < 1
    assert abs(df.u.mean() - 0.5) < 0.02
    assert abs(df.z.mean()) < 0.06 and abs(df.z.std() - 1) < 0.05


def test_keys_do_not_depend_on_partitioning(spark):
    base = spark.range(500)
    first = rows(base.repartition(1).select("id", keys.hash_key(7, "id")))
    assert first == rows(base.repartition(17).select("id", keys.hash_key(7, "id")))


def test_probs(spark):
    df = spark.createDataFrame([([2.0, 1.0, 1.0],), ([0.0, 0.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(probs.renormalize_probs("p")).collect()]
    assert got == [[0.5, 0.25, 0.25], [0.0, 0.0, 0.0]]
    z = spark.createDataFrame([([0.0],), ([0.0, 1000.0],), ([1.0, 2.0, 3.0],)], "z array<double>")
    one, two, three = [r[0] for r in z.select(probs.probs_from_logits("z")).collect()]
    assert one == [0.5] and two == [1.0]
    e = np.exp([1, 2, 3])
    assert np.allclose(three, e / e.sum())


def test_predicted_class_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.5],), ([0.1, 0.7, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(probs.predict_class("p")).collect()] == [0, 1, 1]
    assert df.select(probs.top_class("p")).first()[0].pred_prob == 0.5


def test_prob_columns_in_numeric_order(spark):
    df = spark.createDataFrame([tuple([0.0] * 11)], [f"prob_{i}" for i in (0, 1, 10, 2, 3, 4, 5, 6, 7, 8, 9)])
    assert probs.prob_columns(df) == [f"prob_{i}" for i in range(11)]
    with pytest.raises(ValueError, match="No probability columns"):
        probs.with_probs(spark.range(1))


def _skewed(spark, n=900):
    """A third of all rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20)
    return spark.range(n).select(key.alias("k"), "id", keys.hash_key(1, "id").alias("h"))


@pytest.mark.parametrize("parts", [1, 17])
def test_ranked_matches_a_plain_sort(spark, parts):
    df = _skewed(spark).repartition(parts)
    out = spread.ranked(df, ["k"], [F.col("h")], [keys.hash_bucket(F.col("h"), 1), keys.hash_bucket(F.col("h"), 2)], "r", "n")
    got = out.toPandas()
    want = got.sort_values(["k", "h"]).groupby("k").cumcount() + 1
    assert (got.loc[want.index, "r"] == want).all()
    assert (got.groupby("k").id.transform("size") == got.n).all()


def test_running_sums_without_groups(spark):
    df = _skewed(spark)
    out = spread.running_sums(df, [], [F.col("id")], [F.shiftright("id", 7), F.shiftright("id", 3)], {"s": F.col("id")})
    got = out.toPandas().sort_values("id")
    assert (got.s_before == got.id.cumsum() - got.id).all()
    assert (got.s_total == got.id.sum()).all()


def test_keep_lowest_and_lookup(spark):
    df = _skewed(spark)
    kept = spread.keep_lowest(df, ["k"], [F.col("h")], 5, ["id"]).toPandas()
    want = df.toPandas().sort_values(["k", "h"]).groupby("k").head(5)
    assert set(kept.id) == set(want.id)
    sizes = df.groupBy("k").count()
    joined = spread.lookup(df, sizes, ["k"], ["id"]).toPandas()
    assert len(joined) == 900 and (joined.groupby("k").id.transform("size") == joined["count"]).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(0, 50, 501), 1)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: r for r in spread.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    for k in (0, 1):
        want = np.percentile(values[k::2], [10, 50, 90])
        assert np.allclose([got[k].a, got[k].b, got[k].c], want)


def test_marked_rows_all_pass_and_few_others(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 != 0, F.col("id")).alias("id"), F.lit("x").alias("map"))
    wanted = rows.filter("id % 10 = 3 or id is null")
    mark = F.xxhash64("id", "map")
    for most in (wanted.count(), 1):  # 1: too few bits lose nothing
        found = spread.marked(rows, mark, spread.marks_of(wanted, mark, most), most)
        assert found.columns == rows.columns
        assert found.join(wanted.distinct(), found.id.eqNullSafe(wanted.id), "left_semi").count() == wanted.count()
        assert found.count() < 200_000 if most == 1 else wanted.count() <= found.count() < 36_000
    assert spread.marked(rows, mark, spread.marks_of(wanted.limit(0), mark, 0), 0).count() == 0
