"""Split schemes, roles, balance and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagstats.operators import manifest as M
from bagstats.operators import splits as S
from suite import views as V
from suite.sql import key, uniform, with_views

RULE = "site = '1-URGENT' and label = 'F'"
VAL_RULE = "site = '2-HIGH' and label = 'O'"
_KEEP = ["slide_id", "group_id", "label"]


def kfold(spark, sf):
    return S.kfold_split(V.manifest(spark, sf), 5, 42).select(*_KEEP, "fold")


def kfold_test(spark, sf):
    return S.kfold_split(V.manifest(spark, sf), 5, 42, test_ratio=0.2).select(*_KEEP, "fold")


def holdout(spark, sf):
    return S.holdout_split(V.manifest(spark, sf), 0.7, 0.15, 0.15, 42).select(*_KEEP, "split")


def custom_holdout(spark, sf):
    return S.custom_holdout_split(V.manifest(spark, sf), RULE, val_ratio=0.15, train_ratio=0.7).select(*_KEEP, "split")


def custom_holdout_rules(spark, sf):
    return S.custom_holdout_split(V.manifest(spark, sf), RULE, val_filter=VAL_RULE).select(*_KEEP, "split")


def custom_kfold(spark, sf):
    return S.custom_kfold_split(V.manifest(spark, sf), RULE, 5, 42).select(*_KEEP, "fold", "split")


def monte_carlo(spark, sf):
    return S.monte_carlo_split(V.manifest(spark, sf), 3, 0.7, 0.15, 0.15, 42).select("slide_id", "repeat", "split")


def hash_split(spark, sf):
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    return S.hash_threshold_split(V.manifest(spark, sf), ratios, 42).select(*_KEEP, "split")


def roles(spark, sf):
    splits = S.kfold_split(V.manifest(spark, sf), 5, 42, test_ratio=0.2)
    return S.fold_roles(splits, "kfold", 5).select("fold", "slide_id", "role")


def refit_roles(spark, sf):
    splits = S.kfold_split(V.manifest(spark, sf), 5, 42, test_ratio=0.2)
    return S.fold_roles(splits, "kfold", refit=True).select("fold", "slide_id", "role")


def training_ids(spark, sf):
    return S.all_training_ids(S.kfold_split(V.manifest(spark, sf), 5, 42, test_ratio=0.2), "kfold")


def sharded(spark, sf):
    return S.shard(V.manifest(spark, sf).select("slide_id"), 7)


def summary(spark, sf):
    splits = S.custom_kfold_split(V.manifest(spark, sf), RULE, 5, 42)
    return S.split_summary(splits)


def preview(spark, sf):
    return S.split_preview(V.manifest(spark, sf), RULE)


def balance(spark, sf):
    splits = S.kfold_split(V.manifest(spark, sf), 5, 42)
    return V.rounded(S.site_balance(splits, "site", "fold"), 9)


def shares(spark, sf):
    splits = S.kfold_split(V.manifest(spark, sf), 5, 42)
    return V.rounded(S.site_shares(splits, "site", "fold"), 9)


def grown(spark, sf):
    flagged = M.filter_rule(V.manifest(spark, sf), RULE)
    return S.expand_to_groups(flagged).select("slide_id", "group_id", "matched")


def mapped(spark, sf):
    rows = V.manifest(spark, sf)
    return S.map_back(rows, M.group_majority_label(rows).withColumnRenamed("label", "group_label")).select(
        "slide_id", "group_id", "label", "group_label"
    )


def leakage(spark, sf):
    """Violations of a split that ignores groups on purpose: folds by order number."""
    rows = V.manifest(spark, sf).withColumn("fold", (F.substring("slide_id", 7, 20).cast("bigint") % 3).cast("int"))
    return S.split_leakage(S.fold_roles(rows, "kfold", 3))


def no_leakage(spark, sf):
    """Counts of violations of the real k-fold split: always zero."""
    splits = S.kfold_split(V.manifest(spark, sf), 5, 42)
    return S.split_leakage(S.fold_roles(splits, "kfold", 5)).agg(F.count(F.lit(1)).alias("n_violations"))


def repeats_union(spark, sf):
    rows = V.manifest(spark, sf)
    parts = [
        S.hash_threshold_split(rows, {"train": 0.7, "val": 0.15, "test": 0.15}, 42 + r).withColumn("repeat", F.lit(r))
        for r in range(3)
    ]
    return S.union_all(parts).select("slide_id", "repeat", "split")


def rare_labels(spark, sf):
    """Labels of (site, status) pairs that own fewer groups than folds."""
    rows = V.manifest(spark, sf).withColumn("label", F.concat_ws("/", "label", F.substring("group_id", -1, 1)))
    return S.small_labels(rows, 60)


QUERIES = {
    "W1_kfold_split": kfold,
    "W1_kfold_with_test": kfold_test,
    "W2_holdout_split": holdout,
    "W3_custom_holdout_ratio": custom_holdout,
    "W3_custom_holdout_rules": custom_holdout_rules,
    "W4_custom_kfold_split": custom_kfold,
    "W5_monte_carlo_split": monte_carlo,
    "W6_fold_roles": roles,
    "W6_refit_roles": refit_roles,
    "W7_hash_threshold_split": hash_split,
    "W8_shard": sharded,
    "J1_expand_to_groups": grown,
    "J2_map_back": mapped,
    "A5_split_summary": summary,
    "A6_split_preview": preview,
    "A7_site_balance": balance,
    "A7_site_shares": shares,
    "Q5_split_leakage": leakage,
    "Q5_no_leakage": no_leakage,
    "U1_union_repeats": repeats_union,
    "U4_all_training_ids": training_ids,
    "W1_small_labels": rare_labels,
}


def _folds_cte(groups: str, name: str = "folds", k: int = 5, seed: int = 42) -> str:
    return f"""
{name}_r AS (SELECT group_id, label, row_number() OVER (PARTITION BY label ORDER BY {key(seed, "group_id")}, group_id) AS place FROM {groups}),
{name}_l AS (SELECT label, sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start
             FROM (SELECT label, count(*) AS n FROM {groups} GROUP BY 1)),
{name} AS (SELECT group_id, CAST((place - 1 + coalesce(start, 0)) % {k} AS INT) AS fold FROM {name}_r JOIN {name}_l USING (label))"""


def _quota_cte(source: str, size: str, share: float, quota: str, name: str, by: str = "") -> str:
    """CTE ``name``: ``source`` (one row per label) plus ``quota``; wanted = ceil(share of all), largest remainders first."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
{name}_1 AS (SELECT *, sum({size}) OVER ({part}) AS total FROM {source}),
{name}_2 AS (SELECT *, ceil(CAST(total AS DOUBLE) * {share!r}::DOUBLE - 1e-9::DOUBLE) AS wanted FROM {name}_1),
{name}_3 AS (SELECT *, CAST({size} AS DOUBLE) * wanted / CAST(greatest(total, 1) AS DOUBLE) AS exact FROM {name}_2),
{name}_4 AS (SELECT *, floor(exact + 1e-9::DOUBLE) AS base FROM {name}_3),
{name}_5 AS (SELECT *, row_number() OVER ({part} ORDER BY round(exact - base, 9) DESC, label) AS turn, wanted - sum(base) OVER ({part}) AS spare FROM {name}_4),
{name} AS (SELECT * EXCLUDE (total, wanted, exact, base, turn, spare), base + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS {quota} FROM {name}_5)"""


def _placed(groups: str, seed: object, name: str, by: str = "") -> str:
    pre = f"{by}, " if by else ""
    return f"""{name}_n AS (SELECT {pre}label, count(*) AS n FROM {groups} GROUP BY ALL),
{name} AS (SELECT {pre}group_id, label, row_number() OVER (PARTITION BY {pre}label ORDER BY {key(seed, "group_id")}, group_id) AS place FROM {groups})"""


_KFOLD_TEST = f"""
WITH {_placed("v_group", 42, "p")}, {_quota_cte("p_n", "n", 0.2, "test", "q")},
st AS (SELECT label, test, coalesce(sum(n - test) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q),
assigned AS (SELECT group_id, CAST(CASE WHEN place <= test THEN -1 ELSE (CAST(place - test AS BIGINT) - 1 + CAST(start AS BIGINT)) % 5 END AS INT) AS fold FROM p JOIN st USING (label)),
split AS (SELECT slide_id, group_id, label, fold FROM v_manifest JOIN assigned USING (group_id))"""


def _holdout_cte(groups: str, seed: object, by: str = "") -> str:
    pre = f"{by}, " if by else ""
    return f"""{_placed(groups, seed, "p", by)}, {_quota_cte("p_n", "n", 0.15, "test", "q", by)},
r AS (SELECT *, n - test AS rest FROM q), {_quota_cte("r", "rest", 0.15 / (0.7 + 0.15), "val", "v", by)},
assigned AS (SELECT {pre}group_id, CASE WHEN place <= test THEN 'test' WHEN place <= test + val THEN 'val' ELSE 'train' END AS split FROM p JOIN v USING ({pre}label))"""


_HOLDOUT_GROUPS = f"WITH {_holdout_cte('v_group', 42)}"
_MC = f"WITH g AS (SELECT r AS repeat, group_id, label FROM v_group, range(3) t(r)), {_holdout_cte('g', '(42 + repeat)', 'repeat')}"

_FLAGGED = f"flagged AS (SELECT *, bool_or({RULE}) OVER (PARTITION BY group_id) AS is_test FROM v_manifest)"
_POOL = f"""
pool AS (SELECT * FROM flagged WHERE NOT is_test),
pool_group AS (SELECT group_id, label FROM (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS r
  FROM (SELECT group_id, label, count(*) AS n FROM pool GROUP BY 1, 2)) WHERE r = 1)"""
_CUSTOM_KFOLD = f"""
WITH {_FLAGGED}, {_POOL}, {_folds_cte("pool_group")},
split AS (SELECT slide_id, group_id, label, CAST(-1 AS INT) AS fold, 'test' AS split FROM flagged WHERE is_test
          UNION ALL SELECT slide_id, group_id, label, fold, 'train_val_pool' FROM pool JOIN folds USING (group_id))"""

_KFOLD = f"WITH {_folds_cte('v_group')}, split AS (SELECT slide_id, group_id, label, site, fold FROM v_manifest JOIN folds USING (group_id))"

_U42 = {s: uniform(s, "group_id") for s in (42, 43, 44)}


def _hash_case(seed: int) -> str:
    return f"CASE WHEN {_U42[seed]} < 0.7::DOUBLE THEN 'train' WHEN {_U42[seed]} < {0.7 + 0.15!r}::DOUBLE THEN 'val' ELSE 'test' END"


_SHARES = f"""{_KFOLD},
c AS (SELECT site, fold, count(*) AS n FROM split GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT site FROM c), (SELECT DISTINCT fold FROM c)),
f AS (SELECT site, fold, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (site, fold)),
sh AS (SELECT site, fold, n, n / sum(n) OVER (PARTITION BY fold) AS share,
       sum(n) OVER (PARTITION BY site) / sum(n) OVER () AS overall FROM f)"""

ORACLES = {
    "W1_kfold_split": with_views("v_manifest v_group", f"{_KFOLD} SELECT slide_id, group_id, label, fold FROM split"),
    "W1_kfold_with_test": with_views("v_manifest v_group", f"{_KFOLD_TEST} SELECT * FROM split"),
    "W2_holdout_split": with_views("v_manifest v_group", f"{_HOLDOUT_GROUPS} SELECT slide_id, group_id, label, split FROM v_manifest JOIN assigned USING (group_id)"),
    "W3_custom_holdout_ratio": with_views("v_manifest", f"""
WITH {_FLAGGED}, {_POOL}, {_placed("pool_group", 42, "p")}, {_quota_cte("p_n", "n", 0.15 / (0.7 + 0.15), "quota", "q")},
t AS (SELECT group_id, place <= quota AS taken FROM p JOIN q USING (label))
SELECT slide_id, f.group_id AS group_id, f.label AS label,
       CASE WHEN is_test THEN 'test' WHEN coalesce(t.taken, FALSE) THEN 'val' ELSE 'train' END AS split
FROM flagged f LEFT JOIN t ON t.group_id = f.group_id AND NOT f.is_test"""),
    "W3_custom_holdout_rules": with_views("v_manifest", f"""
WITH {_FLAGGED}
SELECT slide_id, group_id, label, CASE WHEN is_test THEN 'test'
  WHEN bool_or(({VAL_RULE}) AND NOT is_test) OVER (PARTITION BY group_id) THEN 'val' ELSE 'train' END AS split FROM flagged"""),
    "W4_custom_kfold_split": with_views("v_manifest", f"{_CUSTOM_KFOLD} SELECT * FROM split"),
    "W5_monte_carlo_split": with_views("v_manifest v_group", f"{_MC} SELECT slide_id, CAST(repeat AS INT) AS repeat, split FROM v_manifest JOIN assigned USING (group_id)"),
    "W6_fold_roles": with_views("v_manifest v_group", f"""{_KFOLD_TEST}
SELECT CAST(k AS INT) AS fold, slide_id, CASE WHEN fold = -1 THEN 'test' WHEN fold = k THEN 'val' ELSE 'train' END AS role FROM split, range(5) t(k)"""),
    "W6_refit_roles": with_views("v_manifest v_group", f"""{_KFOLD_TEST}
SELECT CAST(0 AS INT) AS fold, slide_id, CASE WHEN fold = -1 THEN 'test' ELSE 'train' END AS role FROM split"""),
    "W7_hash_threshold_split": with_views("v_manifest", f"SELECT slide_id, group_id, label, {_hash_case(42)} AS split FROM v_manifest"),
    "W8_shard": with_views("v_manifest", "SELECT slide_id, CAST((row_number() OVER (ORDER BY slide_id) - 1) % 7 AS INT) AS shard FROM v_manifest"),
    "J1_expand_to_groups": with_views("v_manifest", f"SELECT slide_id, group_id, bool_or({RULE}) OVER (PARTITION BY group_id) AS matched FROM v_manifest"),
    "J2_map_back": with_views("v_manifest v_group", "SELECT slide_id, m.group_id AS group_id, m.label AS label, g.label AS group_label FROM v_manifest m JOIN v_group g USING (group_id)"),
    "A5_split_summary": with_views("v_manifest", f"""{_CUSTOM_KFOLD},
long AS (SELECT 'all' AS part, 'all' AS value, label, group_id FROM split UNION ALL SELECT 'fold', CAST(fold AS VARCHAR), label, group_id FROM split
         UNION ALL SELECT 'split', split, label, group_id FROM split)
SELECT part, value, label, count(*) AS n_slides, count(DISTINCT group_id) AS n_groups FROM long GROUP BY GROUPING SETS ((part, value, label), (part, value))"""),
    "A6_split_preview": with_views("v_manifest", f"""
SELECT label, count(*) AS n_slides, count(DISTINCT group_id) AS n_groups, count(*) FILTER ({RULE}) AS n_matched FROM v_manifest GROUP BY GROUPING SETS ((label), ())"""),
    "A7_site_balance": with_views("v_manifest v_group", f"""{_SHARES},
d AS (SELECT *, abs(share - overall) AS deviation FROM sh)
SELECT round(deviation, 9) AS max_deviation, site AS worst_site, CAST(fold AS VARCHAR) AS worst_split, deviation > 0.15 AS imbalanced
FROM d ORDER BY round(deviation, 9) DESC, site DESC, fold DESC LIMIT 1"""),
    "A7_site_shares": with_views("v_manifest v_group", f"{_SHARES} SELECT site, fold, n, round(share, 9) AS share, round(overall, 9) AS overall, round(abs(share - overall), 9) AS deviation FROM sh"),
    "Q5_split_leakage": with_views("v_manifest", """
WITH s AS (SELECT *, CAST(substr(slide_id, 7) AS BIGINT) % 3 AS own FROM v_manifest),
r AS (SELECT CAST(k AS INT) AS fold, group_id, slide_id, CASE WHEN own = k THEN 'val' ELSE 'train' END AS role FROM s, range(3) t(k))
SELECT fold, group_id AS id, 'group in several roles' AS rule, count(DISTINCT role) AS n FROM r GROUP BY 1, 2 HAVING count(DISTINCT role) > 1
UNION ALL SELECT fold, slide_id, 'slide placed twice', count(*) FROM r GROUP BY 1, 2 HAVING count(*) > 1"""),
    "Q5_no_leakage": with_views("v_manifest v_group", f"""{_KFOLD},
r AS (SELECT k AS fold, s.group_id, slide_id, CASE WHEN s.fold = k THEN 'val' ELSE 'train' END AS role FROM split s, range(5) t(k))
SELECT count(*) AS n_violations FROM (SELECT fold, group_id FROM r GROUP BY 1, 2 HAVING count(DISTINCT role) > 1
  UNION ALL SELECT fold, slide_id FROM r GROUP BY 1, 2 HAVING count(*) > 1)"""),
    "U1_union_repeats": with_views("v_manifest", " UNION ALL ".join(f"SELECT slide_id, CAST({r} AS INT) AS repeat, {_hash_case(42 + r)} AS split FROM v_manifest" for r in range(3))),
    "U4_all_training_ids": with_views("v_manifest v_group", f"{_KFOLD_TEST} SELECT DISTINCT slide_id FROM split WHERE fold <> -1"),
    "W1_small_labels": with_views("v_manifest", """
WITH r AS (SELECT group_id, label || '/' || right(group_id, 1) AS label FROM v_manifest),
g AS (SELECT group_id, label FROM (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS k
  FROM (SELECT group_id, label, count(*) AS n FROM r GROUP BY 1, 2)) WHERE k = 1)
SELECT label, count(*) AS n FROM g GROUP BY 1 HAVING count(*) < 60"""),
}
