"""Ids, manifest preparation, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagstats.functions import ids
from bagstats.operators import manifest as M
from bagstats.operators import quality as Q
from bagstats.operators import splits as S
from suite import views as V
from suite.sql import with_views

# Raw file names in every form the id rules know, made from the order table.
_RAW_SQL = """
SELECT o_orderkey, list_extract([' ', './', 'nested\\', '/mounted/slides/', '/data/root/sub/'], CAST(o_orderkey % 5 + 1 AS INT))
  || 'case.' || CAST(o_orderkey AS VARCHAR)
  || list_extract(['.SVS', '.h5', '.NDPI', '.8923A151', '.svs.tiff', ''], CAST(o_orderkey % 6 + 1 AS INT)) AS raw
FROM orders"""
_SUFFIX_SQL = r"'\.(bif|h5|mrxs|ndpi|npy|npz|parquet|pt|scn|sdpc|svs|tif|tiff|vsi)$'"


def _raw(spark, sf):
    heads = F.array(*[F.lit(p) for p in (" ", "./", "nested\\", "/mounted/slides/", "/data/root/sub/")])
    tails = F.array(*[F.lit(s) for s in (".SVS", ".h5", ".NDPI", ".8923A151", ".svs.tiff", "")])
    key = F.col("o_orderkey")
    raw = F.concat(
        F.element_at(heads, (key % 5 + 1).cast("int")),
        F.lit("case."),
        key.cast("string"),
        F.element_at(tails, (key % 6 + 1).cast("int")),
    )
    return V.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


def normalize(spark, sf):
    return _raw(spark, sf).select(
        "o_orderkey",
        ids.normalize_slide_id("raw").alias("plain_id"),
        ids.normalize_slide_id("raw", "/data/root").alias("rooted_id"),
    )


def from_path(spark, sf):
    path = F.concat(F.lit("/store/"), F.col("o_orderpriority"), F.lit("/a.b/s."), F.col("o_orderkey").cast("string"), F.lit(".h5"))
    rows = V.table(spark, sf, "orders").select("o_orderkey", path.alias("path"))
    with_id = rows.withColumn("slide_id", ids.slide_id_from_path("path", "/store"))
    return with_id.select("o_orderkey", "slide_id", ids.path_from_slide_id("slide_id", "/store").alias("back"))


def best_epoch(spark, sf):
    ending = F.when(F.col("event_id") % 3 == 0, F.lit("last.ckpt")).otherwise(
        F.concat(F.lit("best-epoch="), F.col("user_id").cast("string"), F.lit("-val/loss=0.12.ckpt"))
    )
    other = F.concat(F.lit("runs/epoch="), F.col("user_id").cast("string"), F.lit("-step=500.ckpt"))
    rows = V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, ending).otherwise(other).alias("path")
    )
    return rows.select("event_id", ids.parse_best_epoch("path").alias("best_epoch"))


def _labelled(spark, sf):
    """Documents with a quality label where there is one."""
    docs = V.table(spark, sf, "documents").select("doc_id", "source")
    marks = V.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(marks, "doc_id", "left")


def unlabelled(spark, sf):
    return M.drop_unlabelled(_labelled(spark, sf).select("doc_id", "label"))


def rule(spark, sf):
    out = M.filter_rule(V.manifest(spark, sf), "`site` == '1-URGENT' and label <> 'P'")
    return out.select("slide_id", "matched")


def groups(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.concat(F.lit("slide_"), F.col("o_orderkey").cast("string")).alias("slide_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("patient"),
    )
    return M.derive_group(rows, "patient").select("slide_id", "group_id")


def finalized(spark, sf):
    rows = V.manifest(spark, sf).withColumn("split", F.lit("train")).withColumn("extra", F.lit(1))
    return S.finalize_split_columns(rows, "holdout", site_col="site")


def restricted(spark, sf):
    listed = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("./slide_"), F.col("l_orderkey").cast("string"), F.lit(".svs")).alias("filename")
    )
    return M.restrict_to_manifest(V.manifest(spark, sf), listed).select("slide_id", "label")


def default_label(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("slide_id"))
    marks = V.table(spark, sf, "labels").select(F.col("doc_id").alias("slide_id"), F.col("quality").alias("label"))
    return M.label_or_default(docs, marks)


def patient(spark, sf):
    preds = V.predictions(spark, sf).select("slide_id", "label")
    owners = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("slide_id"), F.col("o_custkey").alias("patient_id"), "o_totalprice"
    ).filter("o_totalprice > 50000")
    return M.attach_patient(preds, owners, order_col="o_totalprice")


def labels_attached(spark, sf):
    events = V.table(spark, sf, "events").select(F.col("user_id").alias("slide_id"), "event_id")
    marks = V.table(spark, sf, "labels").select(F.col("doc_id").alias("slide_id"), F.col("quality").alias("label"))
    return M.attach_labels(events, marks)


def missing(spark, sf):
    have = V.table(spark, sf, "lineitem").select(F.concat(F.lit("slide_"), F.col("l_orderkey").cast("string")).alias("slide_id"))
    return M.missing_features(V.manifest(spark, sf), have)


def _done(spark, sf):
    stamp = F.when(F.col("l_returnflag") == "A", "enc-1").otherwise("enc-2")
    return V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("slide_"), F.col("l_orderkey").cast("string")).alias("slide_id"), stamp.alias("fingerprint")
    )


def pending(spark, sf):
    return M.pending_slides(V.manifest(spark, sf), _done(spark, sf), "enc-1")


def dedup(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("slide_"), F.col("l_orderkey").cast("string")).alias("slide_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("__order"),
    )
    first, _ = M.dedup_slides(rows, "__order")
    return first.drop("__order")


def dedup_report(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slide_id"), "l_partkey")
    return M.dedup_slides(rows, "l_partkey")[1]


def label_counts(spark, sf):
    return M.label_distribution(V.manifest(spark, sf))


def majority(spark, sf):
    return M.group_majority_label(V.manifest(spark, sf))


def sizes(spark, sf):
    rows = V.manifest(spark, sf)
    return M.distinct_counts(rows, n_classes="label", n_groups="group_id")


def sorted_ids(spark, sf):
    return M.sorted_slides(V.manifest(spark, sf).select("slide_id", "label"))


def first_examples(spark, sf):
    return M.first_n_examples(missing(spark, sf), "slide_id")


def best_rows(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("level"))
    return M.argmax_with_ties(rows, F.col("level"), [F.col("o_orderkey")], ["o_custkey"])


def _lists(spark, sf):
    expected = V.manifest(spark, sf).select("slide_id")
    found = V.table(spark, sf, "lineitem").select(F.concat(F.lit("slide_"), (F.col("l_orderkey") + 7).cast("string")).alias("slide_id"))
    return expected, found


def difference(spark, sf):
    return M.expected_minus_found(*_lists(spark, sf))


def completeness_counts(spark, sf):
    return M.found_and_expected(*_lists(spark, sf))


def completeness(spark, sf):
    return Q.completeness(*_lists(spark, sf))


def not_empty(spark, sf):
    return Q.not_empty(V.manifest(spark, sf))


def nans(spark, sf):
    noisy = V.predictions(spark, sf).withColumn(
        "prob_0", F.when(F.col("fold") == 0, F.lit(None)).when(F.col("fold") == 1, F.lit(float("nan"))).otherwise(1 - F.col("prob_1"))
    )
    return Q.no_nans(noisy)


def fingerprint(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return Q.order_free_fingerprint(rows)


def counts(spark, sf):
    return Q.subgroup_counts(V.predictions(spark, sf))


_FOUND = "SELECT 'slide_' || CAST(l_orderkey AS VARCHAR) AS slide_id FROM lineitem"
_SHIFTED = "SELECT 'slide_' || CAST(l_orderkey + 7 AS VARCHAR) AS slide_id FROM lineitem"

QUERIES = {
    "P1_normalize_slide_id": normalize,
    "P2_slide_id_from_path": from_path,
    "P3_drop_unlabelled": unlabelled,
    "P4_filter_rule": rule,
    "P5_derive_group": groups,
    "P6_finalize_split_columns": finalized,
    "P7_restrict_to_manifest": restricted,
    "P8_label_or_default": default_label,
    "F_parse_best_epoch": best_epoch,
    "J3_attach_patient": patient,
    "J4_attach_labels": labels_attached,
    "J5_missing_features": missing,
    "J6_pending_slides": pending,
    "A1_dedup_slides": dedup,
    "A1_dedup_report": dedup_report,
    "A2_label_distribution": label_counts,
    "A3_group_majority_label": majority,
    "A36_num_classes_groups": sizes,
    "A38_order_free_fingerprint": fingerprint,
    "A40_subgroup_counts": counts,
    "T1_sorted_slides": sorted_ids,
    "T3_first_n_examples": first_examples,
    "T4_argmax_with_ties": best_rows,
    "U2_expected_minus_found": difference,
    "U3_found_and_expected": completeness_counts,
    "Q3_not_empty": not_empty,
    "Q4_no_nans": nans,
    "Q8_completeness": completeness,
}

_COUNT_SQL = f"""
WITH e AS (SELECT DISTINCT 'slide_' || CAST(o_orderkey AS VARCHAR) AS slide_id FROM orders),
     f AS (SELECT DISTINCT slide_id FROM ({_SHIFTED}))
SELECT CAST(count(*) AS BIGINT) AS total, count(f.slide_id) AS found, count(*) - count(f.slide_id) AS missing
FROM e LEFT JOIN f USING (slide_id)"""

_DIGEST_SQL = r"sha256(concat_ws(chr(31), 'v' || CAST(o_orderkey AS VARCHAR), 'v' || CAST(o_custkey AS VARCHAR), 'v' || o_orderstatus, 'v' || o_orderpriority))"
_LANE_SQL = ", ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4)
)

ORACLES = {
    "P1_normalize_slide_id": f"""
WITH r AS (SELECT o_orderkey, replace(trim(raw), chr(92), '/') AS p FROM ({_RAW_SQL})),
     b AS (SELECT o_orderkey, CASE WHEN p LIKE '/%' THEN regexp_extract(p, '[^/]+$') ELSE p END AS plain,
                  CASE WHEN p LIKE '/data/root/%' THEN substr(p, 12) WHEN p LIKE '/%' THEN regexp_extract(p, '[^/]+$') ELSE p END AS rooted FROM r)
SELECT o_orderkey, regexp_replace(regexp_replace(plain, '^\\./', ''), {_SUFFIX_SQL}, '', 'i') AS plain_id,
       regexp_replace(regexp_replace(rooted, '^\\./', ''), {_SUFFIX_SQL}, '', 'i') AS rooted_id FROM b""",
    "P2_slide_id_from_path": """
SELECT o_orderkey, o_orderpriority || '/a.b/s.' || CAST(o_orderkey AS VARCHAR) AS slide_id,
       '/store/' || o_orderpriority || '/a.b/s.' || CAST(o_orderkey AS VARCHAR) || '.h5' AS back FROM orders""",
    "P3_drop_unlabelled": "SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "P4_filter_rule": with_views("v_manifest", "SELECT slide_id, site = '1-URGENT' AND label <> 'P' AS matched FROM v_manifest"),
    "P5_derive_group": """
SELECT 'slide_' || CAST(o_orderkey AS VARCHAR) AS slide_id,
       CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey AS VARCHAR) ELSE 'slide_' || CAST(o_orderkey AS VARCHAR) END AS group_id FROM orders""",
    "P6_finalize_split_columns": with_views("v_manifest", "SELECT slide_id, group_id, filename, label, 'train' AS split, site FROM v_manifest"),
    "P7_restrict_to_manifest": with_views("v_manifest", f"SELECT slide_id, label FROM v_manifest WHERE slide_id IN ({_FOUND})"),
    "P8_label_or_default": "SELECT doc_id AS slide_id, CAST(coalesce(quality, -1) AS INT) AS label FROM documents LEFT JOIN labels USING (doc_id)",
    "F_parse_best_epoch": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(user_id + 1 AS INT) END AS best_epoch FROM events",
    "J3_attach_patient": with_views("v_pred", """
SELECT slide_id, label, coalesce(CAST(o_custkey AS VARCHAR), CAST(slide_id AS VARCHAR)) AS patient_id
FROM v_pred LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 50000) o ON o_orderkey = slide_id"""),
    "J4_attach_labels": "SELECT user_id AS slide_id, event_id, quality AS label FROM events LEFT JOIN labels ON doc_id = user_id",
    "J5_missing_features": with_views("v_manifest", f"SELECT slide_id FROM v_manifest WHERE slide_id NOT IN ({_FOUND})"),
    "J6_pending_slides": with_views("v_manifest", f"SELECT slide_id FROM v_manifest WHERE slide_id NOT IN ({_FOUND} WHERE l_returnflag = 'A')"),
    "A1_dedup_slides": """
SELECT slide_id, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT 'slide_' || CAST(l_orderkey AS VARCHAR) AS slide_id, l_linenumber, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""",
    "A1_dedup_report": "SELECT count(*) - count(DISTINCT l_orderkey) AS n_dropped FROM lineitem",
    "A2_label_distribution": "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1",
    "A3_group_majority_label": with_views("v_manifest v_group", "SELECT group_id, label FROM v_group"),
    "A36_num_classes_groups": "SELECT count(DISTINCT o_orderstatus) AS n_classes, count(DISTINCT o_custkey) AS n_groups FROM orders",
    "A38_order_free_fingerprint": f"""
WITH s AS (SELECT count(*) AS n, {_LANE_SQL} FROM (SELECT {_DIGEST_SQL} AS d FROM orders))
SELECT substr(sha256(concat_ws('|', 'o_orderkey,o_custkey,o_orderstatus,o_orderpriority', CAST(n AS VARCHAR), s0, s1, s2, s3)), 1, 12) AS fingerprint FROM s""",
    "A40_subgroup_counts": with_views("v_pred", """
SELECT count(*) AS n_rows, count(DISTINCT slide_id) AS n_slides, count(DISTINCT patient_id) AS n_patients, count(DISTINCT fold) AS n_folds FROM v_pred"""),
    "T1_sorted_slides": with_views("v_manifest", "SELECT slide_id, label FROM v_manifest ORDER BY slide_id"),
    "T3_first_n_examples": with_views("v_manifest", f"SELECT slide_id FROM v_manifest WHERE slide_id NOT IN ({_FOUND}) ORDER BY slide_id LIMIT 10"),
    "T4_argmax_with_ties": """
SELECT o_custkey, o_orderkey, level FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY level DESC, o_orderkey) AS r
  FROM (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 100000) AS BIGINT) AS level FROM orders)) WHERE r = 1""",
    "U2_expected_minus_found": f"SELECT 'slide_' || CAST(o_orderkey AS VARCHAR) AS slide_id FROM orders EXCEPT {_SHIFTED}",
    "U3_found_and_expected": _COUNT_SQL,
    "Q3_not_empty": "SELECT count(*) > 0 AS not_empty FROM orders",
    "Q4_no_nans": """
SELECT 'prob_0' AS "column", CAST(count(*) FILTER (event_id % 5 = 1) AS BIGINT) AS n_nan, CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS n_null FROM events
UNION ALL SELECT 'prob_1', 0, 0""",
    "Q8_completeness": f"SELECT *, missing = 0 AS complete FROM ({_COUNT_SQL})",
}
