import pytest
from helpers import rows
from pyspark.sql import functions as F

from bagstats.operators import manifest as M
from bagstats.operators import quality as Q
from bagstats.operators import splits as S


@pytest.fixture(scope="module")
def manifest(spark):
    """120 slides of 60 groups; one group owns a third of all slides."""
    data = []
    for i in range(120):
        group = "g0" if i % 3 == 0 else f"g{i % 60}"
        data.append((f"s{i}", group, f"s{i}.svs", "pos" if i % 5 == 0 else "neg", f"site{i % 4}"))
    return spark.createDataFrame(data, "slide_id string, group_id string, filename string, label string, site string").cache()


def _group_parts(df, column):
    return df.groupBy("group_id").agg(F.count_distinct(column).alias("n")).filter("n > 1").count()


def test_manifest_preparation(spark):
    raw = spark.createDataFrame(
        [("a.svs", "1", "p1", 0), ("a.SVS", "0", "p2", 1), ("b.h5", None, "p1", 2), ("c", "0", None, 3)],
        "file string, grade string, patient string, line int",
    )
    out = M.prepare_manifest(raw, "file", "grade", "patient", "line")
    assert rows(out.select("slide_id", "group_id", "label")) == [("a", "p1", "1"), ("c", "c", "0")]
    with pytest.raises(ValueError, match="Available"):
        M.prepare_manifest(raw, "missing", "grade")


def test_dedup_reports_dropped(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "slide_id string, o int")
    first, dropped = M.dedup_slides(df, "o")
    assert rows(first) == [("a", 1), ("b", 3)]
    assert dropped.first()[0] == 1


def test_rules_are_checked(spark, manifest):
    with pytest.raises(ValueError, match="and"):
        M.filter_rule(manifest, "(label = 'pos') & (site = 'site0')")
    with pytest.raises(ValueError, match="Failed to evaluate"):
        M.filter_rule(manifest, "no_such_column = 1")
    with pytest.raises(ValueError, match="not a predicate"):
        M.filter_rule(manifest, "1 + 1")


def test_restrict_rejects_empty_ids(spark, manifest):
    bad = spark.createDataFrame([("s1",), (None,)], "slide_id string")
    with pytest.raises(Exception, match="null or empty slide id"):
        M.restrict_to_manifest(manifest, bad).collect()


def test_attach_patient_fallbacks(spark):
    preds = spark.createDataFrame([("a", 1), ("b", 0)], "slide_id string, label int")
    owners = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2)], "slide_id string, patient_id string, line int")
    assert rows(M.attach_patient(preds, owners, order_col="line").select("slide_id", "patient_id")) == [("a", "p2"), ("b", "b")]
    assert rows(M.attach_patient(preds, None).select("patient_id")) == [("a",), ("b",)]


@pytest.mark.parametrize("test_ratio", [None, 0.2])
def test_kfold(spark, manifest, test_ratio):
    out = S.kfold_split(manifest, 5, 42, test_ratio)
    assert out.count() == 120 and _group_parts(out, "fold") == 0
    sizes = [r["n"] for r in out.filter("fold >= 0").groupBy("fold").agg(F.count_distinct("group_id").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    groups = M.group_majority_label(manifest).join(out.select("group_id", "fold").distinct(), "group_id")
    for label in ("pos", "neg"):
        per = [r["count"] for r in groups.filter((F.col("label") == label) & (F.col("fold") >= 0)).groupBy("fold").count().collect()]
        assert max(per) - min(per) <= 1
    if test_ratio:
        n_test = out.filter("fold = -1").select("group_id").distinct().count()
        n_all = manifest.select("group_id").distinct().count()
        assert n_test == -(-n_all * 2 // 10)


def test_splits_do_not_depend_on_partitioning(spark, manifest):
    one = rows(S.kfold_split(manifest.repartition(1), 5, 42).select("slide_id", "fold"))
    many = rows(S.kfold_split(manifest.orderBy(F.desc("slide_id")).repartition(17), 5, 42).select("slide_id", "fold"))
    assert one == many
    assert one != rows(S.kfold_split(manifest, 5, 43).select("slide_id", "fold"))


def test_holdout_and_monte_carlo(spark, manifest):
    out = S.holdout_split(manifest, 0.6, 0.2, 0.2, 1)
    assert out.count() == 120 and _group_parts(out, "split") == 0
    n = manifest.select("group_id").distinct().count()
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("group_id").alias("n")).collect()}
    n_test = -(-n * 2 // 10)
    assert got["test"] == n_test and abs(got["val"] - (n - n_test) * 0.25) <= 1
    repeats = S.monte_carlo_split(manifest, 3, 0.6, 0.2, 0.2, 1)
    assert repeats.count() == 360
    assert rows(repeats.filter("repeat = 0").select("slide_id", "split")) == rows(out.select("slide_id", "split"))
    with pytest.raises(ValueError, match="sum to 1"):
        S.holdout_split(manifest, 0.5, 0.2, 0.2)


def test_custom_schemes(spark, manifest):
    rule = "site = 'site1' and label = 'pos'"
    holdout = S.custom_holdout_split(manifest, rule, val_ratio=0.25)
    folds = S.custom_kfold_split(manifest, rule, 4)
    for out in (holdout, folds):
        assert out.count() == 120 and _group_parts(out, "split") == 0
        assert out.filter(f"({rule}) and split <> 'test'").count() == 0
    assert folds.filter("(split = 'test') <> (fold = -1)").count() == 0
    with pytest.raises(ValueError, match="val_filter"):
        S.custom_kfold_split(manifest, rule, 4, val_filter="true")
    with pytest.raises(Exception, match="Not enough slides"):
        S.custom_kfold_split(manifest, "true", 4).collect()


def test_roles_and_leakage(spark, manifest):
    splits = S.kfold_split(manifest, 3, 42, 0.2)
    roles = S.fold_roles(splits, "kfold", 3)
    assert roles.count() == 360 and S.split_leakage(roles).count() == 0
    assert S.all_training_ids(splits, "kfold").count() == splits.filter("fold >= 0").count()
    mc = spark.createDataFrame(
        [("a", 0, "train"), ("b", 0, "val"), ("c", 0, "test"), ("a", 1, "test"), ("b", 1, "train"), ("c", 1, "val")],
        "slide_id string, repeat int, split string",
    )
    got = rows(S.fold_roles(mc, "monte_carlo").filter("fold = 1").select("slide_id", "role"))
    assert got == [("a", "test"), ("b", "train"), ("c", "val")]
    assert rows(S.all_training_ids(mc, "monte_carlo")) == [("a",), ("b",)]
    with pytest.raises(ValueError, match="repeat"):
        S.fold_roles(splits, "monte_carlo")
    bad = roles.unionByName(roles.filter("fold = 0").limit(1).withColumn("role", F.lit("other")))
    assert S.split_leakage(bad).count() > 0


def test_shard_and_balance(spark, manifest):
    got = S.shard(manifest.select("slide_id"), 7).toPandas().sort_values("slide_id")
    assert list(got["shard"]) == [i % 7 for i in range(120)]
    skewed = manifest.withColumn("split", F.when(F.col("site") == "site0", "train").otherwise("test"))
    row = S.site_balance(skewed, "site", "split").first()
    assert row.imbalanced and row.worst_site == "site0" and row.worst_split == "train"


def test_fingerprint(spark, manifest):
    mark = Q.order_free_fingerprint(manifest).first()[0]
    assert mark == Q.order_free_fingerprint(manifest.orderBy(F.desc("slide_id")).repartition(9)).first()[0]
    changed = manifest.withColumn("label", F.when(F.col("slide_id") == "s1", "x").otherwise(F.col("label")))
    assert mark != Q.order_free_fingerprint(changed).first()[0]
    assert mark != Q.order_free_fingerprint(manifest.unionByName(manifest.limit(1))).first()[0]
    assert Q.order_free_fingerprint(manifest.filter("false")).first()[0] == "empty"


def test_shards_of_ids_with_a_long_common_prefix(spark):
    """Sorted ranges are cut by Spark's sampling: no task gets them all, and every n-th id has the same shard."""
    ids = spark.range(0, 20_000).select(F.format_string("a common prefix of thirty-five letters %08d", F.col("id") * 37 % 20_000).alias("slide_id"))
    found = S.shard(ids.repartition(3), 7)
    spread_over = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]
    got = found.toPandas().sort_values("slide_id")["shard"].tolist()
    assert got == [k % 7 for k in range(20_000)]
    assert len(spread_over) > 1
    assert S.shard(spark.createDataFrame([], "slide_id string"), 3).count() == 0
