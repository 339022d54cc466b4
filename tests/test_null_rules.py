"""Null keys, wrong class counts and gaps lose no row without a word."""

import re

import pytest
from pyspark.sql import functions as F

from bagstats.functions import spread
from bagstats.operators import bags, bootstrap, confusion, manifest, scores, splits
from bagstats.sources import store


def _manifest(spark):
    rows = [(f"s{k}", f"g{k // 2}" if k % 10 else None, None if k % 4 == 0 else "ab"[k % 2]) for k in range(40)]
    return spark.createDataFrame(rows, "slide_id string, group_id string, label string")


@pytest.mark.parametrize("ratio", [None, 0.2])
def test_kfold_keeps_slides_without_label_or_group(spark, ratio):
    slides = _manifest(spark)
    out = splits.kfold_split(slides, 5, 42, ratio)
    assert sorted(r.slide_id for r in out.collect()) == sorted(r.slide_id for r in slides.collect())
    assert out.filter("fold is null").count() == 0


def test_other_splits_keep_every_slide(spark):
    slides = _manifest(spark)
    for out in (splits.holdout_split(slides, 0.6, 0.2, 0.2), splits.custom_holdout_split(slides, "label = 'a'", val_ratio=0.2)):
        assert out.count() == 40 and out.filter("split is null").count() == 0


def test_ranked_counts_null_groups_and_levels(spark):
    df = spark.createDataFrame([(None, None), (None, 1), ("", 2), ("a", None), ("a", 5)], "k string, v int")
    out = spread.ranked(df, ["k"], [F.col("v")], [F.col("v")], "r", "n").collect()
    assert sorted(((r.k, r.v, r.r, r.n) for r in out), key=repr) == sorted(
        [(None, None, 1, 2), (None, 1, 2, 2), ("", 2, 1, 1), ("a", None, 1, 2), ("a", 5, 2, 2)], key=repr
    )


def test_lookup_multiplies_nothing(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 7)
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = spread.lookup(big, small, ["k"], ["id"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1000 and out.columns == ["id", "k", "v"]


def test_slides_without_patient_stay_apart(spark):
    df = spark.createDataFrame(
        [("a", None, 0, 0.1), ("b", None, 1, 0.9), ("c", "p", 1, 0.8), ("d", "p", 1, 0.6)],
        "slide_id string, patient_id string, label int, prob_1 double",
    )
    rows = scores.patient_aggregate(df).collect()
    assert sorted((r.patient_id or "", r.n_slides) for r in rows) == [("", 1), ("", 1), ("p", 2)]
    cells = bootstrap._cells(df, "patient_id", [], "prob_1")
    assert cells.select("unit").distinct().count() == 3


def test_wrong_class_counts_fail(spark):
    df = spark.createDataFrame([("a", 2, [0.1, 0.2, 0.7])], "slide_id string, label int, probs array<double>")
    with pytest.raises(Exception, match="expected 2 classes"):
        scores.class_rows(df, 2).collect()
    with pytest.raises(Exception, match="expected 2 classes"):
        scores.crop_average(df, 2).collect()
    with pytest.raises(Exception, match="outside 2 classes"):
        confusion.confusion_matrix(df, 2).collect()
    assert confusion.confusion_matrix(df, 3).agg(F.sum("n")).first()[0] == 1


def test_unlabelled_rows_are_no_class(spark):
    df = spark.createDataFrame([("a", -1, 0.1), ("b", 1, 0.9)], "slide_id string, label int, prob_1 double")
    with pytest.raises(Exception, match="outside 2 classes"):
        confusion.confusion_matrix(df, 2).collect()


def test_rules_may_quote_any_sign(spark):
    df = spark.createDataFrame([("A&B",), ("x|y",)], "label string")
    assert manifest.filter_rule(df, "label = 'A&B' or label = 'it''s|'").filter("matched").count() == 1
    with pytest.raises(ValueError, match=re.escape("'and' / 'or'")):
        manifest.filter_rule(df, "label = 'a' & label = 'b'")


def test_quantiles_pass_over_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (None,)], "v double")
    assert spread.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 2.0


def test_bags_hold_what_a_cap_left(spark):
    rows = [(s, 3 * k, k, k, [float(k)]) for s in (1, 2) for k in range(60 * s)]
    patches = spark.createDataFrame(rows, "slide_id long, patch_idx int, x int, y int, features array<float>")
    capped = bags.cap_random_k(patches, 50)
    lengths = {r.slide_id: r.length for r in bags.assemble_bags(capped, 50, pad=False).collect()}
    assert lengths == {1: 50, 2: 50}
    assert bags.cap_first_k(patches, 70).groupBy("slide_id").count().orderBy("slide_id").collect() == [(1, 60), (2, 70)]
    batches = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "slide_id long, bucket int, batch_no int")
    out = bags.assemble_batches(patches, batches, 90).collect()
    assert {(r.slide_id, r.length, len(r.features), sum(r.mask)) for r in out} == {(1, 60, 90, 60), (2, 90, 90, 90)}
    assert dict(bags.feature_noise(patches, 0.1).dtypes)["features"] == "array<float>"


def test_no_pack_of_several_bags_passes_the_limit(spark):
    index = spark.createDataFrame([(k, 700 if k % 3 else 1500) for k in range(40)], "slide_id long, est_bytes long")
    packs = store.pack_by_size(index, 1000).groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.sum("est_bytes").alias("b"))
    assert packs.filter("n > 1 and b > 1000").count() == 0 and packs.agg(F.sum("n")).first()[0] == 40
