import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from bagstats.operators import quality as Q
from bagstats.plans import evaluation as PE
from bagstats.plans import splitting as PS
from bagstats.plans import storing as PT
from bagstats.functions.keys import hash_key
from bagstats.operators import manifest as M
from bagstats.sources import shared, store, tables
from bagstats.sources import validated as VD
from bagstats.streaming import jobs


@pytest.fixture(scope="module")
def patches(spark):
    data = [(f"s{s}", i, i % 5 * 256, i // 5 * 256, [float(s), float(i)]) for s in range(6) for i in range(s * 10 + 3)]
    return spark.createDataFrame(data, "slide_id string, patch_idx int, x int, y int, features array<double>").cache()


def _csv(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)


def test_bag_checks_first_reason_wins(spark):
    data = [
        ("ok", 0, 1, [1.0, 2.0]), ("ok", 1, 1, [1.0, 2.0]),
        ("nofeat", 0, 1, None), ("nocoord", 0, None, [1.0, 2.0]), ("mixed", 0, 1, [1.0]), ("mixed", 1, 1, [1.0, 2.0]),
        ("half", 0, 1, [1.0, 2.0]), ("half", 1, 1, None), ("other", 0, 1, [1.0]), ("twice", 0, 1, [1.0, 2.0]), ("twice", 0, 1, [1.0, 2.0]),
        ("empty", 0, 1, []),
    ]
    df = spark.createDataFrame(data, "slide_id string, patch_idx int, x int, features array<double>").withColumn("y", F.col("x"))
    valid, rejects = Q.validate_bags(df)
    assert rows(valid.select("slide_id")) == [("ok",)]
    assert dict(rows(rejects.select("slide_id", "reason"))) == {
        "nofeat": Q.REJECT_NO_FEATURES, "nocoord": Q.REJECT_NO_COORDS, "mixed": Q.REJECT_MIXED_DIM, "half": Q.REJECT_MISMATCH,
        "other": Q.REJECT_FOREIGN_DIM, "twice": Q.REJECT_DUPLICATE, "empty": Q.REJECT_EMPTY_DIM,
    }


def test_store_round_trip(spark, patches):
    path = shared.fresh_path(spark, "store")
    bad = store.write_patch_store(patches, path, cap=20, strategy="random", max_records_per_file=7, n_shards=3, seed=1)
    assert bad.count() == 0
    index = {r.slide_id: r for r in spark.read.parquet(f"{path}/index").collect()}
    assert index["s5"].n_patches == 20 and index["s5"].raw_patches == 53 and index["s0"].n_patches == 3
    some = store.read_patches(spark, f"{path}/patches", ["s0", "s1"])
    assert some.count() == 16
    assert store.read_patches(spark, f"{path}/patches", window=(0, 2)).filter("slide_id = 's0'").count() == 2


def test_damaged_index_is_reported(spark, patches):
    index = store.bag_index(patches, n_shards=2)
    assert Q.validate_bag_index(index, patches, 2).count() == 0
    moved = index.withColumn("start_row", F.when(F.col("slide_id") == "s3", F.col("start_row") + 1).otherwise(F.col("start_row")))
    assert "range gap" in {r.rule for r in Q.validate_bag_index(moved, patches, 2).collect()}
    short = Q.validate_bag_index(index, patches.filter("not (slide_id = 's2' and patch_idx = 0)"), 2)
    assert rows(short) == [("s2", "count differs from patches")]


def _sequential(sizes, limit):
    """Next-fit as a loop."""
    out, number, used = [], 0, 0
    for size in sizes:
        if used > 0 and used + size > limit:
            number, used = number + 1, 0
        used += size
        out.append(number)
    return out


@pytest.mark.parametrize("case", ["mixed", "oversized", "one shard", "zero"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_packing_is_the_sequential_one(spark, case, parts):
    size = {"mixed": F.col("id") % 9 * 40 + 10, "oversized": F.when(F.col("id") % 5 == 0, 900).otherwise(30), "one shard": F.lit(1), "zero": F.col("id") % 3 * 250}[case]
    index = spark.range(211).select(F.col("id").alias("slide_id"), size.cast("bigint").alias("est_bytes")).repartition(parts)
    got = store.pack_by_size(index, 500, exact=True).withColumn("k", hash_key("pack", "slide_id")).toPandas().sort_values(["k", "slide_id"])
    assert len(got) == 211 and got.pack.tolist() == _sequential(got.est_bytes, 500)
    loose = store.pack_by_size(index, 500).groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.sum("est_bytes").alias("b"))
    assert loose.filter("n > 1 and b > 500").count() == 0


def test_exact_packing_does_not_write_all_bags_every_round(spark, monkeypatch):
    held = []
    monkeypatch.setattr(store, "written", lambda df, name: held.append(shared.written(df, name)) or held[-1])
    index = spark.range(3000).select(F.col("id").alias("slide_id"), (F.col("id") % 7 * 24 + 24).alias("est_bytes"))
    got = store.pack_by_size(index, 512, exact=True).withColumn("k", hash_key("pack", "slide_id")).toPandas().sort_values(["k", "slide_id"])
    assert got.pack.tolist() == _sequential(got.est_bytes, 512)
    assert sum(df.count() for df in held) < 2 * 3000


def test_packing_of_no_bags(spark):
    assert store.pack_by_size(spark.createDataFrame([], "slide_id long, est_bytes long"), 500, exact=True).count() == 0


def test_identity_sees_changed_files(spark, patches):
    path, again = shared.fresh_path(spark, "files"), shared.fresh_path(spark, "files")
    patches.write.parquet(path)
    mark = Q.source_identity(spark.read.parquet(path), {"cap": 5})
    plan = mark._jdf.queryExecution().executedPlan().toString()
    assert "features" not in plan  # no column of the table is read
    first = mark.first()[0]
    assert first == Q.source_identity(spark.read.parquet(path), {"cap": 5}).first()[0] != Q.source_identity(spark.read.parquet(path), {"cap": 6}).first()[0]
    spark.read.parquet(path).withColumn("features", F.transform("features", lambda v: v + 1)).write.parquet(again)
    assert Q.source_identity(spark.read.parquet(again), {"cap": 5}).first()[0] != first
    # A table that is not read from files is known by its rows.
    held = patches.select("slide_id", "features")
    moved = held.withColumn("features", F.transform("features", lambda v: v + 1))
    assert Q.source_identity(held, {}).first()[0] == Q.source_identity(held.repartition(3), {}).first()[0] != Q.source_identity(moved, {}).first()[0]


def test_store_is_built_anew_when_files_change(spark, patches):
    source, path = shared.fresh_path(spark, "source"), shared.fresh_path(spark, "plan")
    patches.write.parquet(source)
    config = PT.StoreConfig(cap=10, grid=4, n_shards=2)
    assert PT.build_store(spark.read.parquet(source), path, config)["coverage"].count() == 6
    assert PT.build_store(spark.read.parquet(source), path, config) is None
    patches.withColumn("features", F.transform("features", lambda v: v * 2)).write.mode("overwrite").parquet(source)
    mark = Q.source_identity(spark.read.parquet(source), {}).first()
    assert mark is not None and not PT._same_source(PT._mark(spark.read.parquet(source), None, config), path)


def test_rows_keep_their_place_in_the_file(spark):
    """First and last rows of a slide by place, with quoted line breaks, equal rows and several files."""
    path = shared.fresh_path(spark, "csv")
    lines = ["filename,label,patient_id"] + [f'"dir/s{k % 7}.svs",{"abc"[k % 3]},"p\n{k}"' for k in range(50)]
    _csv(spark, f"{path}/a", lines)
    _csv(spark, f"{path}/b", ["filename,label,patient_id", '"dir/s1.svs",z,"last\nof all"', '"dir/s9.svs",y,'])
    files = f"{path}/*"
    first = {r.slide_id: r for r in tables.read_manifest(spark, files).collect()}
    assert {k: (r.label, r.patient_id) for k, r in first.items()} == {
        **{f"dir/s{k}": ("abc"[k % 3], f"p\n{k}") for k in range(7)}, "dir/s9": ("y", None),
    }
    every = tables.read_csv_in_order(spark, files).withColumn("slide_id", F.regexp_replace("filename", r"\.svs$", ""))
    preds = spark.createDataFrame([(f"dir/s{k}",) for k in (0, 1, 6, 9, 12)], "slide_id string")
    last = {r.slide_id: r.patient_id for r in M.attach_patient(preds, every.repartition(5)).collect()}
    assert last == {"dir/s0": "p\n49", "dir/s1": "last\nof all", "dir/s6": "p\n48", "dir/s9": "dir/s9", "dir/s12": "dir/s12"}


def test_checks_are_made_while_writing(spark, patches):
    path = shared.fresh_path(spark, "checked")
    preds = spark.createDataFrame([(1, 0.5), (0, float("nan")), (1, None)], "label int, prob_1 double")
    rules = VD.composed(VD.not_empty(), VD.no_nans(preds), [VD.holds("label", "label in (0, 1)")])
    with pytest.raises(VD.ValidationError, match="no NaN in prob_1': 2"):
        VD.write_validated(preds, path, rules)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        VD.read_validated(spark, path)
    fine = shared.fresh_path(spark, "checked")
    report = VD.write_validated(preds.filter("prob_1 = 0.5"), fine, rules)
    assert rows(report) == [("label", 0, 1), ("no NaN in prob_1", 0, 1), ("not empty", 0, 1)]
    assert VD.read_validated(spark, fine).count() == 1
    empty = VD.write_validated(preds.limit(0), shared.fresh_path(spark, "checked"), rules, fail=False)
    assert rows(empty.filter("violations > 0")) == [("not empty", 1, 0)]
    bad = VD.write_validated(patches.withColumn("x", F.lit(None).cast("int")), shared.fresh_path(spark, "checked"), VD.whole_patches(2), fail=False)
    assert rows(bad.filter("violations > 0").select("rule", "violations")) == [("coordinates present", patches.count())]


def test_splits_reuse_and_refusal(spark):
    csv, out = shared.fresh_path(spark, "csv"), shared.fresh_path(spark, "splits")
    _csv(spark, csv, ["De ID,grade,patient"] + [f"s{i}.svs,{'a' if i % 3 else 'b'},p{i // 2}" for i in range(40)])
    config = PS.SplitConfig("kfold", "De ID", "grade", "patient", n_folds=4)
    first = PS.make_splits(spark, csv, out, config)
    again = PS.make_splits(spark, csv, out, config)
    assert rows(first["splits"]) == rows(again["splits"]) and first["splits"].count() == 40
    with pytest.raises(tables.IntegrityError, match="settings"):
        PS.make_splits(spark, csv, out, PS.SplitConfig("kfold", "De ID", "grade", "patient", n_folds=5))
    other = shared.fresh_path(spark, "csv")
    _csv(spark, other, ["De ID,grade,patient"] + [f"s{i}.svs,{'a' if i % 2 else 'b'},p{i // 2}" for i in range(40)])
    with pytest.raises(tables.IntegrityError, match="contents"):
        PS.make_splits(spark, other, out, config)
    with pytest.raises(ValueError, match="Unknown scheme"):
        PS.SplitConfig("nope")
    with pytest.raises(ValueError, match="sum to 1"):
        PS.SplitConfig("holdout", train=0.5, val=0.1, test=0.1)


def test_store_plan_skips_unchanged_input(spark, patches):
    path = shared.fresh_path(spark, "plan")
    manifest = spark.createDataFrame([(f"s{i}",) for i in range(5)], "slide_id string")
    config = PT.StoreConfig(cap=10, grid=4, n_shards=2)
    reports = PT.build_store(patches, path, config, manifest)
    assert reports["violations"].count() == 0 and reports["coverage"].count() == 5
    assert PT.build_store(patches, path, config, manifest) is None
    with pytest.raises(ValueError, match="have no patches"):
        PT.build_store(patches, shared.fresh_path(spark, "plan"), config, spark.createDataFrame([("zz",)], "slide_id string"))
    with pytest.raises(ValueError, match="positive"):
        PT.StoreConfig(cap=0)


def test_evaluation_plan(spark):
    rows_ = [(f"s{i}", f"p{i // 2}", i % 3, int(i % 2), 0.2 + 0.3 * (i % 2) + (i % 5) / 20) for i in range(60)]
    preds = spark.createDataFrame(rows_, "slide_id string, patient_id string, fold int, label int, prob_1 double")
    config = PE.EvaluationConfig(n_bootstrap=12)
    only = PE.evaluate(preds, None, None, config)
    assert set(only) == {"oof_counts", "oof_metrics", "oof_fold_summary"}
    both = PE.evaluate(preds, preds.drop("fold"), None, config)
    path = shared.fresh_path(spark, "evaluation")
    PE.write_evaluation({k: both[k] for k in ("held_out_operating_points", "held_out_ece")}, path)
    assert spark.read.json(f"{path}/held_out_ece").count() == 1
    assert both["held_out_intervals"].count() == 16 and both["held_out_roc"].count() > 2
    assert both["held_out_patient_confusion"].agg(F.sum("n")).first()[0] == 30
    youden = both["held_out_operating_points"].filter("point = 'youdens_j'").first().threshold
    assert both["held_out_threshold_stability"].filter("delta = 0").first().threshold == pytest.approx(youden)
    two = preds.drop("fold").withColumn("prob_0", 1 - F.col("prob_1"))
    named = PE.evaluate_model(two, None, config)
    assert {"intervals", "checks", "threshold_stability"} <= set(named) and named["intervals"].count() == 16


def test_report_writes_nulls(spark):
    path = shared.fresh_path(spark, "report")
    tables.write_report(spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, 0.5)], "a int, v double"), path)
    text = sorted(r.value for r in spark.read.text(path).collect())
    assert text == ['{"a":1,"v":null}', '{"a":2,"v":null}', '{"a":3,"v":0.5}']


def test_slide_lists(spark):
    path = shared.fresh_path(spark, "list")
    _csv(spark, path, ["  /wsi/a/b.svs ", "", "   ", "c.ndpi"])
    assert rows(tables.read_slide_list(spark, path, "/wsi")) == [("a/b",), ("c",)]


def test_stream_equals_batch(spark, patches):
    folder = shared.fresh_path(spark, "in")
    once = patches.select("slide_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    once.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(once.schema).parquet(folder)
    out, check = shared.fresh_path(spark, "out"), shared.fresh_path(spark, "check")
    jobs.run_available(jobs.stream_ingest_diff(stream, "f1"), out, check).awaitTermination()
    assert rows(spark.read.parquet(out).select("slide_id")) == [(f"s{i}",) for i in range(6)]
    once.write.mode("append").parquet(folder)
    jobs.run_available(jobs.stream_ingest_diff(stream, "f1"), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_long_slide_lists(spark, patches):
    path = shared.fresh_path(spark, "listed")
    patches.write.parquet(path)
    wanted = ["s1", "s3", *[f"none{k}" for k in range(2000)]]
    assert store.read_patches(spark, path, wanted).select("slide_id").distinct().count() == 2
    assert store.read_patches(spark, path, wanted).count() == store.read_patches(spark, path, wanted[:2]).count() == 13 + 33


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_table_of_files(spark, tmp_path, files):
    """A table may be a folder of files; beside it lie others, which are no part of the stream."""
    from suite import stores

    spark.range(9).repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(90, 99).write.parquet(f"{tmp_path}/orders.parquet")
    out = stores._drained(stores._stream(spark, str(tmp_path), "events"), "stream-test")
    assert rows(out) == [(k,) for k in range(9)]


def test_a_store_is_sorted_in_pieces_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_BYTES", 2000)
    bags = spark.range(600).select((F.col("id") % 5).alias("slide_id"), F.floor(F.col("id") / 5).cast("int").alias("patch_idx"), F.lit(1).alias("x"), F.col("id").cast("int").alias("y"), F.array(F.lit(0.5), F.lit(1.5)).alias("features"))
    path = shared.fresh_path(spark, "store")
    assert store.write_patch_store(bags, path, cap=40, strategy="random", n_shards=2, seed=1).count() == 0
    back = spark.read.parquet(f"{path}/patches")
    assert back.groupBy("slide_id").count().filter("count = 40").count() == 5
    assert back.select(F.input_file_name()).distinct().count() > 5


def test_facts_of_bags_are_taken_once(spark, patches, monkeypatch):
    held = []
    monkeypatch.setattr(Q, "written", lambda df, name: held.append(name) or shared.written(df, name), raising=False)
    assert Q.judge_bags(patches).count() == patches.select("slide_id").distinct().count() and held == ["facts"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def names():
        files = disk.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size())}

    before = names()
    table = shared.written(spark.range(10_000).repartition(7, "id"), "ids")
    for _ in range(50):
        if not any(n.startswith("shuffle_") for n in names() - before):
            break
        time.sleep(0.2)
    assert not [n for n in names() - before if n.startswith("shuffle_")]
    assert table.count() == 10_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
