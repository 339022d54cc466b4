"""Round trips through storage, index checks, identities and streams.

Everything is written below the cluster's shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bagstats.operators import bags as B
from bagstats.operators import coverage as C
from bagstats.operators import manifest as M
from bagstats.operators import pooling as P
from bagstats.operators import quality as Q
from bagstats.operators import ranking as R
from bagstats.operators import splits as S
from bagstats.sources import store as ST
from bagstats.sources import tables as T
from bagstats.sources import validated as VD
from bagstats.sources.shared import fresh_path
from bagstats.streaming import jobs as J
from suite import views as V
from suite.bags import K, ORACLES as BAG_ORACLES
from suite.evaluation import ORACLES as EVAL_ORACLES
from suite.scoring import WIDE_HEAD, _pairs
from suite.splits import ORACLES as SPLIT_ORACLES
from suite.sql import with_views


def manifest_csv(spark, sf):
    """Order table as a CSV manifest with awkward names, read back as slides."""
    path = fresh_path(spark, "manifest")
    rows = V.manifest(spark, sf).select(
        F.concat(F.lit(" ./"), F.substring("filename", 8, 100)).alias("De ID"),
        F.when(F.col("label") != "P", F.col("label")).alias("WHO 1973"),
        F.when(F.col("site") != "5-LOW", F.col("group_id")).alias("patient"),
        "site",
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    out = T.read_manifest(spark, path, "De ID", "WHO 1973", "patient", "site")
    return out.select("slide_id", "group_id", "label", "site")


def splits_stored(spark, sf):
    path = fresh_path(spark, "splits")
    manifest = V.manifest(spark, sf)
    T.write_splits(S.kfold_split(manifest, 5, 42), path, manifest, "kfold-5-42")
    return T.read_splits(spark, path, manifest, "kfold-5-42").select("slide_id", "group_id", "label", "fold")


def _hash_splits(manifest):
    return S.hash_threshold_split(manifest, {"train": 0.7, "val": 0.15, "test": 0.15}).select("slide_id", "group_id", "label", "split")


def integrity(spark, sf):
    """Against the right manifest and against one in which a tenth of the labels changed."""
    path = fresh_path(spark, "splits")
    manifest = V.manifest(spark, sf)
    T.write_splits(_hash_splits(manifest), path, manifest, "hash-42")
    changed = manifest.withColumn("label", F.when(F.col("slide_id").endswith("7"), "X").otherwise(F.col("label")))
    good = T.verify_integrity(spark, path, manifest).select(F.lit("same").alias("case"), "*")
    return good.unionByName(T.verify_integrity(spark, path, changed).select(F.lit("changed").alias("case"), "*"))


def identity(spark, sf):
    """Settings that hold facts of the table, against the same and against those of the table without one site."""
    path = fresh_path(spark, "splits")
    manifest = V.manifest(spark, sf)
    T.write_splits(_hash_splits(manifest), path, manifest, f"hash-42;slides={manifest.count()}")
    fewer = manifest.filter("site <> '1-URGENT'").count()
    good = T.verify_identity(spark, path, f"hash-42;slides={manifest.count()}").select(F.lit("same").alias("case"), "*")
    return good.unionByName(T.verify_identity(spark, path, f"hash-42;slides={fewer}").select(F.lit("other").alias("case"), "*"))


def identity_of_files(spark, sf):
    """The mark of a table's files: read again, and after its features (and nothing else) were written anew."""
    path, other = fresh_path(spark, "patches"), fresh_path(spark, "patches")
    rows = V.patches(spark, sf)
    rows.write.parquet(path)
    changed = F.transform("features", lambda v: v + 1)
    spark.read.parquet(path).withColumn("features", changed).write.parquet(other)
    marks = [Q.source_identity(spark.read.parquet(p), {"cap": 200}).first()[0] for p in (path, path, other)]
    slides = spark.read.parquet(other).agg(F.count_distinct("slide_id").alias("n_slides"), F.count(F.lit(1)).alias("n_patches"))
    return slides.select("*", F.lit(marks[0] == marks[1]).alias("same_again"), F.lit(marks[0] == marks[2]).alias("same_after_change"))


def manifest_in_order(spark, sf):
    """Items as a CSV in the order of their number, most slides several times: the first row of a slide stays, the last names its patient."""
    path = fresh_path(spark, "manifest")
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    slide = F.concat(F.lit("scan\n"), (F.col("o_orderkey") % 997).cast("string"), F.lit(".svs"))  # a line break inside a value
    sorted_rows = rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    sorted_rows.select(slide.alias("filename"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("patient_id")).write.option("header", True).csv(path)
    first = T.read_manifest(spark, path)
    every = T.read_csv_in_order(spark, path).withColumn("slide_id", F.regexp_replace("filename", r"\.svs$", ""))
    last = M.attach_patient(first.select("slide_id", "label"), every)
    return last.select(F.substring("slide_id", 6, 10).cast("bigint").alias("slide_no"), "label", F.col("patient_id").cast("bigint").alias("patient_id"))


def checked_while_written(spark, sf):
    """Damaged patches and predictions, all rules in the pass that writes them."""
    patches = _broken(spark, sf).withColumn("features", F.when((F.col("slide_id") % 10 == 7) & (F.col("x") == 0), F.array(*[F.lit(float("nan"))] * 4)).otherwise(F.col("features")))
    preds = V.predictions(spark, sf).withColumn("prob_1", F.when(F.col("slide_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("prob_1")))
    one = VD.write_validated(patches, fresh_path(spark, "checked"), VD.composed(VD.not_empty(), VD.whole_patches(4)), fail=False)
    rules = VD.composed(VD.not_empty(), VD.no_nans(preds), VD.holds("two labels", "label in (0, 1)"))
    two = VD.write_validated(preds, fresh_path(spark, "checked"), rules, fail=False)
    return one.withColumn("table", F.lit("patches")).unionByName(two.withColumn("table", F.lit("predictions")))


def _stored_patches(spark, sf):
    path = fresh_path(spark, "patches")
    V.patches(spark, sf).write.parquet(path)
    return path


def patches_read(spark, sf):
    """Slides of one nation, a window of patch numbers."""
    wanted = V.table(spark, sf, "supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("slide_id"))
    out = ST.read_patches(spark, _stored_patches(spark, sf), wanted, window=(10, 60), columns=["slide_id", "patch_idx", "x", "features"])
    return out.select("slide_id", "patch_idx", "x", F.col("features")[1].alias("f1"))


def patches_indexed(spark, sf):
    """Explicit patch rows: those at the left edge of a slide."""
    path = _stored_patches(spark, sf)
    rows = spark.read.parquet(path).filter("x = 0").select("slide_id", "patch_idx")
    return ST.read_patches(spark, path, indices=rows, columns=["slide_id", "patch_idx", "y"])


def store_written(spark, sf):
    """Capped store read back through its index."""
    path = fresh_path(spark, "store")
    violations = ST.write_patch_store(V.stored_patches(spark, sf), path, cap=K, strategy="random", n_shards=8, seed=42)
    index = spark.read.parquet(f"{path}/index")
    total = violations.agg(F.count(F.lit(1))).scalar()
    return index.select("slide_id", "n_patches", "raw_patches", total.alias("n_violations"))


def store_kept(spark, sf):
    path = fresh_path(spark, "store")
    ST.write_patch_store(V.stored_patches(spark, sf), path, cap=K, strategy="random", n_shards=8, seed=42)
    return ST.read_patches(spark, f"{path}/patches", columns=["slide_id", "patch_idx"])


def _broken(spark, sf):
    """Patches damaged by rule: no features, no position, short vectors, repeated rows."""
    sid, idx = F.col("slide_id"), F.col("patch_idx")
    rows = V.patches(spark, sf)
    features = (
        F.when(sid % 10 == 1, F.lit(None))
        .when((sid % 10 == 3) & (idx == 0), F.slice("features", 1, 3))
        .when(sid % 10 == 4, F.slice("features", 1, 2))
        .when((sid % 10 == 5) & (idx == 1), F.lit(None))
        .otherwise(F.col("features"))
    )
    x = F.when(sid % 10 == 2, F.lit(None)).otherwise(F.col("x"))
    damaged = rows.withColumn("features", features).withColumn("x", x)
    return damaged.unionByName(damaged.filter("slide_id % 10 = 6 and patch_idx = 0"))


def validated(spark, sf):
    valid, rejects = Q.validate_bags(_broken(spark, sf))
    ok = valid.select("slide_id", "n_patches", F.lit("valid").alias("reason"))
    return ok.unionByName(rejects.select("slide_id", "n_patches", "reason"))


def rejects_stored(spark, sf):
    path = fresh_path(spark, "rejects")
    T.write_rejects(Q.validate_bags(_broken(spark, sf))[1], path)
    return spark.read.option("header", True).schema("slide_id bigint, n_patches bigint, reason string").csv(path)


def _bad_index(spark, sf):
    index = ST.bag_index(V.patches(spark, sf), n_shards=8).drop("est_bytes")
    sid = F.col("slide_id")
    damaged = (
        index.withColumn("n_patches", F.when(sid % 10 == 1, F.lit(0)).when(sid % 10 == 2, F.col("n_patches") + 1).otherwise(F.col("n_patches")))
        .withColumn("raw_patches", F.when(sid % 10 == 3, F.lit(1)).otherwise(F.col("raw_patches")))
        .withColumn("shard", F.when(sid % 10 == 4, F.lit(9)).otherwise(F.col("shard")))
    )
    return damaged.unionByName(damaged.filter("slide_id % 10 = 5"))


def index_violations(spark, sf):
    return Q.validate_bag_index(_bad_index(spark, sf), V.patches(spark, sf), 8)


def gaps(spark, sf):
    index = ST.bag_index(V.patches(spark, sf), n_shards=8)
    moved = index.withColumn("start_row", F.col("start_row") + F.when(F.col("slide_id") % 7 == 0, 5).otherwise(0))
    return Q.range_gaps(moved)


def source_mark(spark, sf):
    index = ST.bag_index(V.patches(spark, sf), n_shards=8).select("slide_id", "n_patches", "raw_patches", "feat_dim", "coord_dim")
    return Q.source_fingerprint(index, {"cap": 200, "strategy": "random"})


def predictions_stored(spark, sf):
    path = fresh_path(spark, "predictions")
    T.write_predictions(V.predictions(spark, sf), path)
    return V.rounded(T.read_predictions(spark, path))


def embeddings_stored(spark, sf):
    path = fresh_path(spark, "embeddings")
    T.write_embeddings(P.pool_mean(V.embed_patches(spark, sf)), path)
    rows = spark.read.parquet(path).select("slide_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 5))


def report_stored(spark, sf):
    """ROC points as JSON: the infinite threshold becomes null."""
    path = fresh_path(spark, "report")
    T.write_report(R.roc_curve(V.predictions(spark, sf), ["fold"]).select("fold", "threshold", "tp", "fp"), path)
    return V.rounded(spark.read.schema("fold int, threshold double, tp bigint, fp bigint").json(path), 9)


def coverage_stored(spark, sf):
    path = fresh_path(spark, "coverage")
    rows = V.stored_patches(spark, sf, "slide_id", "patch_idx", "x", "y")
    T.write_coverage_stats(C.coverage_stats(rows, B.cap_random_k(rows, K, 42)), path)
    schema = "slide_id bigint, n_total bigint, n_kept bigint, n_discarded bigint, coverage_pct double, was_capped boolean"
    return spark.read.option("header", True).schema(schema).csv(path)


def slide_list(spark, sf):
    """A text list with blank lines, padding and full paths."""
    path = fresh_path(spark, "list")
    line = F.when(F.col("label") == "P", F.lit("   ")).otherwise(F.concat(F.lit("  /mnt/wsi/"), "filename", F.lit(" ")))
    V.manifest(spark, sf).select(line.alias("value")).write.text(path)
    return T.read_slide_list(spark, path, "/mnt/wsi")


def slides_listed(spark, sf):
    """Nations of a folder tree that has a few files per nation's suppliers, found by extension."""
    path = fresh_path(spark, "tree")
    rows = V.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), F.col("s_name").alias("value"))
    salt = F.pmod(F.xxhash64("value"), F.lit(4))  # a nation with most of the rows is not one task's
    rows.repartition("nation", salt).write.partitionBy("nation").text(path)
    found = T.list_slides(spark, path, [".txt"], nested=True)
    return found.select(F.regexp_extract("slide_id", r"nation=(\d+)", 1).alias("nation")).distinct()


def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files: a path with a pattern may stand for either."""
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _drained(out, name):
    spark = out.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    query = J.run_available(out, path, checkpoint)
    query.awaitTermination()
    return spark.read.parquet(path)


def stream_scored(spark, sf):
    rows = _stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("slide_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return _pairs(_drained(J.stream_score(rows, WIDE_HEAD), "stream-score"))


def stream_once(spark, sf):
    rows = _stream(spark, sf, "events").select(F.col("user_id").alias("slide_id"))
    return _drained(J.stream_ingest_diff(rows, "enc-1"), "stream-once")


def stream_once_watermark(spark, sf):
    rows = _stream(spark, sf, "events").select(F.col("user_id").alias("slide_id"), F.col("ts").cast("timestamp"))
    return _drained(J.stream_ingest_diff(rows, "enc-1", "ts", "365 days"), "stream-mark").select("slide_id", "fingerprint")


QUERIES = {
    "S1_read_manifest": manifest_csv,
    "S2_write_read_splits": splits_stored,
    "S3_read_patches": patches_read,
    "S3_read_patches_indices": patches_indexed,
    "S4_write_patch_store": store_written,
    "S4_patch_store_rows": store_kept,
    "S7_write_read_predictions": predictions_stored,
    "S8_write_embeddings": embeddings_stored,
    "S9_write_report": report_stored,
    "S10_write_coverage_stats": coverage_stored,
    "S11_read_slide_list": slide_list,
    "S11_list_slides": slides_listed,
    "S12_write_rejects": rejects_stored,
    "Q1_validate_bags": validated,
    "Q2_validate_bag_index": index_violations,
    "Q6_verify_integrity": integrity,
    "Q7_verify_identity": identity,
    "W10_range_gaps": gaps,
    "A39_source_fingerprint": source_mark,
    "A39_source_identity": identity_of_files,
    "S1_read_manifest_in_order": manifest_in_order,
    "Q9_checked_while_written": checked_while_written,
    "R1_stream_score": stream_scored,
    "R2_stream_ingest_diff": stream_once,
    "R2_stream_ingest_watermark": stream_once_watermark,
}

_BROKEN = """
d AS (SELECT slide_id, patch_idx, CASE WHEN slide_id % 10 = 1 THEN NULL WHEN slide_id % 10 = 3 AND patch_idx = 0 THEN 3 WHEN slide_id % 10 = 4 THEN 2
       WHEN slide_id % 10 = 5 AND patch_idx = 1 THEN NULL ELSE 4 END AS dim, slide_id % 10 <> 2 AS has_xy FROM v_patches),
dd AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE slide_id % 10 = 6 AND patch_idx = 0),
f AS (SELECT slide_id, count(*) AS n_patches, count(dim) AS nf, count(*) FILTER (has_xy) AS nc, min(dim) AS lo, max(dim) AS hi, count(*) - count(DISTINCT patch_idx) AS dup FROM dd GROUP BY 1),
j AS (SELECT slide_id, n_patches, CASE WHEN nf = 0 THEN 'features missing' WHEN nc = 0 THEN 'coords missing' WHEN nf <> nc THEN 'patch count mismatch between features and coords'
       WHEN lo <> hi THEN 'feature dimension differs inside the slide' WHEN dup > 0 THEN 'duplicate patch index' WHEN hi <> 4 THEN 'feature dimension differs from the other slides' ELSE 'valid' END AS reason FROM f)"""

_IDX = "i AS (" + BAG_ORACLES["S5_bag_index"].replace(f"count(*) FILTER (patch_idx < {K})", "count(*)") + ")"
_BAD = f"""{_IDX},
b0 AS (SELECT slide_id, CASE WHEN slide_id % 10 = 1 THEN 0 WHEN slide_id % 10 = 2 THEN n_patches + 1 ELSE n_patches END AS n_patches,
        CASE WHEN slide_id % 10 = 3 THEN 1 ELSE raw_patches END AS raw_patches, CASE WHEN slide_id % 10 = 4 THEN 9 ELSE shard END AS shard, start_row FROM i),
b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE slide_id % 10 = 5)"""


def _gap_cte(source: str) -> str:
    return f"""gap AS (SELECT *, CASE WHEN start_row > expected_start THEN 'gap' ELSE 'overlap' END AS problem FROM (
  SELECT shard, slide_id, start_row, coalesce(lag(start_row + n_patches) OVER (PARTITION BY shard ORDER BY start_row, slide_id), 0) AS expected_start FROM {source}) WHERE start_row <> expected_start)"""


_MARK_DIGEST = "sha256(concat_ws(chr(31), 'v' || CAST(slide_id AS VARCHAR), 'v' || CAST(n_patches AS VARCHAR), 'v' || CAST(raw_patches AS VARCHAR), 'v4', 'v2'))"
_LANES = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4))

_MANIFEST, _SPLITS = ["filename", "group_id", "label", "site", "slide_id"], ["group_id", "label", "slide_id", "split"]


def _order_free(source: str, columns: list[str], name: str) -> str:
    """CTE ``name`` with ``f``: the hash of all rows of a table, whatever their order."""
    marked = ", ".join(f"coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in columns)
    lanes = ", ".join(f"s{i}" for i in range(4))
    return f"""{name}_s AS (SELECT count(*) AS n, {_LANES} FROM (SELECT sha256(concat_ws(chr(31), {marked})) AS d FROM {source})),
{name} AS (SELECT sha256(concat_ws('|', '{",".join(columns)}', CAST(n AS VARCHAR), {lanes})) AS f FROM {name}_s)"""


ORACLES = {
    "S1_read_manifest": with_views("v_manifest", """
SELECT slide_id, CASE WHEN site <> '5-LOW' THEN group_id ELSE slide_id END AS group_id, label, site FROM v_manifest WHERE label <> 'P'"""),
    "S2_write_read_splits": SPLIT_ORACLES["W1_kfold_split"],
    "S3_read_patches": with_views("v_patches", """
SELECT slide_id, patch_idx, x, f1 FROM v_patches WHERE patch_idx >= 10 AND patch_idx < 60 AND slide_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)"""),
    "S3_read_patches_indices": with_views("v_patches", "SELECT slide_id, patch_idx, y FROM v_patches WHERE x = 0"),
    "S4_write_patch_store": with_views("v_patches", f"SELECT slide_id, least(count(*), {K}) AS n_patches, count(*) AS raw_patches, CAST(0 AS BIGINT) AS n_violations FROM v_patches GROUP BY 1"),
    "S4_patch_store_rows": BAG_ORACLES["B2_cap_random_k"],
    "S7_write_read_predictions": with_views("v_pred", "SELECT slide_id, patient_id, fold, label, round(prob_1, 6) AS prob_1 FROM v_pred"),
    "S8_write_embeddings": with_views("v_embed", "SELECT slide_id, CAST(i - 1 AS INT) AS pos, round(CAST(CAST(avg(features[i]) AS FLOAT) AS DOUBLE), 5) AS value FROM v_embed, range(1, 65) t(i) GROUP BY slide_id, i"),
    "S9_write_report": f"SELECT fold, CASE WHEN isinf(threshold) THEN NULL ELSE threshold END AS threshold, tp, fp FROM ({EVAL_ORACLES['A19_roc_curve']})",
    "S10_write_coverage_stats": BAG_ORACLES["A33_coverage_stats"],
    "S11_read_slide_list": with_views("v_manifest", "SELECT 'slides/' || slide_id AS slide_id FROM v_manifest WHERE label <> 'P'"),
    "S11_list_slides": "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
    "S12_write_rejects": with_views("v_patches", f"WITH {_BROKEN} SELECT slide_id, n_patches, reason FROM j WHERE reason <> 'valid'"),
    "Q1_validate_bags": with_views("v_patches", f"WITH {_BROKEN} SELECT slide_id, n_patches, reason FROM j"),
    "Q2_validate_bag_index": with_views("v_patches", f"""
WITH {_BAD}, {_gap_cte("b")}, st AS (SELECT slide_id, count(*) AS stored FROM v_patches GROUP BY 1)
SELECT slide_id, 'duplicate id' AS rule FROM b GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT slide_id, 'count not positive' FROM b WHERE n_patches <= 0
UNION ALL SELECT slide_id, 'raw count below stored' FROM b WHERE raw_patches < n_patches
UNION ALL SELECT slide_id, 'range ' || problem FROM gap
UNION ALL SELECT slide_id, 'shard out of range' FROM b WHERE shard < 0 OR shard >= 8
UNION ALL SELECT slide_id, 'count differs from patches' FROM b FULL JOIN st USING (slide_id) WHERE n_patches IS DISTINCT FROM stored"""),
    "Q6_verify_integrity": with_views("v_manifest", f"""
WITH sp AS ({SPLIT_ORACLES["W7_hash_threshold_split"]}), ch AS (SELECT slide_id, filename, group_id, CASE WHEN slide_id LIKE '%7' THEN 'X' ELSE label END AS label, site FROM v_manifest),
{_order_free("v_manifest", _MANIFEST, "ma")}, {_order_free("ch", _MANIFEST, "mb")}, {_order_free("sp", _SPLITS, "ms")},
digests AS (SELECT substr(sha256(ma.f || '|' || ms.f), 1, 16) AS stored, substr(sha256(mb.f || '|' || ms.f), 1, 16) AS other FROM ma, mb, ms)
SELECT 'same' AS "case", stored, stored AS current, TRUE AS intact FROM digests UNION ALL SELECT 'changed', stored, other, stored = other FROM digests"""),
    "Q7_verify_identity": """
WITH n AS (SELECT sha256('hash-42;slides=' || CAST(count(*) AS VARCHAR)) AS a, sha256('hash-42;slides=' || CAST(count(*) FILTER (o_orderpriority <> '1-URGENT') AS VARCHAR)) AS b FROM orders)
SELECT 'same' AS "case", substr(a, 1, 16) AS stored, substr(a, 1, 16) AS requested, TRUE AS same FROM n
UNION ALL SELECT 'other', substr(a, 1, 16), substr(b, 1, 16), a = b FROM n""",
    "A39_source_identity": with_views("v_patches", "SELECT count(DISTINCT slide_id) AS n_slides, count(*) AS n_patches, TRUE AS same_again, FALSE AS same_after_change FROM v_patches"),
    "S1_read_manifest_in_order": """
SELECT o_orderkey % 997 AS slide_no, arg_min(o_orderstatus, o_orderkey) AS label, arg_max(o_custkey, o_orderkey) AS patient_id FROM orders GROUP BY 1""",
    "Q9_checked_while_written": with_views("v_patches v_pred", f"""
WITH {_BROKEN}, e AS (SELECT dd.*, dim IS NOT NULL AND dim = 4 AND slide_id % 10 = 7 AND x = 0 AS bad FROM dd JOIN v_patches USING (slide_id, patch_idx)),
n AS (SELECT count(*) AS n_rows FROM dd)
SELECT 'patches' AS "table", 'not empty' AS rule, CAST(0 AS BIGINT) AS violations, n_rows FROM n
UNION ALL SELECT 'patches', 'features present', (SELECT count(*) FILTER (dim IS NULL) FROM dd), n_rows FROM n
UNION ALL SELECT 'patches', 'coordinates present', (SELECT count(*) FILTER (NOT has_xy) FROM dd), n_rows FROM n
UNION ALL SELECT 'patches', 'feature dimension', (SELECT count(*) FILTER (dim <> 4) FROM dd), n_rows FROM n
UNION ALL SELECT 'patches', 'no NaN in features', (SELECT count(*) FILTER (bad) FROM e), n_rows FROM n
UNION ALL SELECT 'predictions', 'not empty', 0, count(*) FROM v_pred
UNION ALL SELECT 'predictions', 'no NaN in prob_1', count(*) FILTER (slide_id % 11 = 0), count(*) FROM v_pred
UNION ALL SELECT 'predictions', 'two labels', 0, count(*) FROM v_pred"""),
    "W10_range_gaps": with_views("v_patches", f"""
WITH {_IDX}, m AS (SELECT slide_id, shard, n_patches, start_row + CASE WHEN slide_id % 7 = 0 THEN 5 ELSE 0 END AS start_row FROM i), {_gap_cte("m")} SELECT * FROM gap"""),
    "A39_source_fingerprint": with_views("v_patches", f"""
WITH i AS (SELECT slide_id, count(*) AS n_patches, count(*) AS raw_patches FROM v_patches GROUP BY 1),
s AS (SELECT count(*) AS n, {_LANES} FROM (SELECT {_MARK_DIGEST} AS d FROM i)),
r AS (SELECT sha256(concat_ws('|', 'slide_id,n_patches,raw_patches,feat_dim,coord_dim', CAST(n AS VARCHAR), s0, s1, s2, s3)) AS fingerprint FROM s)
SELECT substr(sha256(fingerprint || '|cap=200;strategy=random'), 1, 20) AS fingerprint FROM r"""),
    "R1_stream_score": None,
    "R2_stream_ingest_diff": "SELECT DISTINCT user_id AS slide_id, 'enc-1' AS fingerprint FROM events",
    "R2_stream_ingest_watermark": "SELECT DISTINCT user_id AS slide_id, 'enc-1' AS fingerprint FROM events",
}


def _stream_sql() -> str:
    from suite.scoring import _classify_sql

    source = "m AS (SELECT vec_id AS slide_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)"
    return f"WITH {source}, {_classify_sql('m', 'e', WIDE_HEAD)}"


ORACLES["R1_stream_score"] = _stream_sql()
