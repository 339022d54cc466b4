"""Pooling and scoring of bags made from the embedding table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bagstats.operators import pooling as P
from bagstats.operators import scores as SC
from bagstats.operators import scoring as S
from bagstats.functions import probs as PR
from bagstats.operators import splits as SP
from suite import views as V
from suite.sql import with_views

DIM, HIDDEN, ATT, CLASSES = 64, 6, 4, 3


def _weights(rows: int, cols: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Model parameters by rule, so the SQL side can state the same numbers."""
    w = [[((i * 7 + j * 3 + salt * 5) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]
    b = [((i + salt) % 5 - 2) / 10 for i in range(rows)]
    return np.array(w), np.array(b)


LAYER = _weights(HIDDEN, DIM, 1)
HEADS = [S.Attention(_weights(ATT, HIDDEN, 2 + h), _weights(1, ATT, 4 + h), _weights(ATT, HIDDEN, 6 + h)) for h in range(2)]
PROJECTION = _weights(HIDDEN, 2 * HIDDEN, 8)
HEAD = _weights(CLASSES, HIDDEN, 9)
WIDE_HEAD = _weights(CLASSES, DIM, 9)  # on whole vectors
MODEL = S.BagModel(HEAD, [LAYER], HEADS[:1])


def _exploded(df, col="embedding", *keep):
    return df.select(*keep, F.posexplode(col).alias("pos", "value")).withColumn("value", F.round("value", 6))


def mean_pool(spark, sf):
    return _exploded(P.pool_mean(V.embed_patches(spark, sf)), "embedding", "slide_id", "n_patches")


def max_pool(spark, sf):
    return _exploded(P.pool_max(V.embed_patches(spark, sf)), "embedding", "slide_id", "n_patches")


def mlp(spark, sf):
    out = S.patch_mlp(V.embed_patches(spark, sf), [LAYER])
    return _exploded(out, "features", "slide_id", "patch_idx")


def logits(spark, sf):
    out = S.attention_logits(S.patch_mlp(V.embed_patches(spark, sf), [LAYER]), HEADS)
    return V.rounded(out.select("slide_id", "patch_idx", F.col("logits")[0].alias("logit_0"), F.col("logits")[1].alias("logit_1"), "logit"))


def _with_logit(spark, sf):
    """Attention scores of the line-item bags: large numbers, so the softmax must be stable."""
    return V.patches(spark, sf).withColumn("logit", F.col("y") / 64.0 + F.col("features")[2] * 10)


def softmax(spark, sf):
    out = P.bag_softmax(_with_logit(spark, sf).select("slide_id", "patch_idx", "logit"))
    return out.select("slide_id", "patch_idx", F.round("attention", 9).alias("attention"))


def pooled(spark, sf):
    return _exploded(P.attention_pool(_with_logit(spark, sf)), "embedding", "slide_id", "n_patches")


def multihead(spark, sf):
    rows = S.patch_mlp(V.embed_patches(spark, sf), [LAYER])
    out = S.multihead_attention_pool(rows, HEADS, PROJECTION)
    return _exploded(out, "embedding", "slide_id", "n_patches")


def _pairs(out):
    return V.rounded(
        out.select(
            "slide_id",
            *[F.col("logits")[c].alias(f"logit_{c}") for c in range(CLASSES)],
            *[F.col("probabilities")[c].alias(f"prob_{c}") for c in range(CLASSES)],
            "pred_class",
            "pred_prob",
        )
    )


def classified(spark, sf):
    return _pairs(S.classify(P.pool_mean(V.embed_patches(spark, sf)), *WIDE_HEAD))


def scored(spark, sf):
    return _pairs(S.score_bags(V.embed_patches(spark, sf), MODEL))


def _mean_head(bag):
    """Plug-in predictor that holds one bag: mean of all features, linear head."""
    w, b = WIDE_HEAD
    vector = bag.astype(float).mean(axis=0)
    return {"embedding": vector, "logits": w @ vector + b}


def _max_head(bag):
    """Plug-in predictor: largest value of every feature, linear head."""
    w, b = WIDE_HEAD
    vector = bag.astype(float).max(axis=0)
    return {"embedding": vector, "logits": w @ vector + b}


def _scored_whole(patches, predict):
    """No bag is cut: the cap is the size of the largest."""
    largest = patches.groupBy("slide_id").count().agg(F.max("count")).first()[0] or 1
    return _pairs(S.score_bags(patches, predict, max_instances=largest))


def scored_by_function(spark, sf):
    return _scored_whole(V.embed_patches(spark, sf), _max_head)


def scored_after_dropout(spark, sf):
    """A third of every bag is gone, all that is left is scored."""
    return _scored_whole(V.embed_patches(spark, sf).filter("patch_idx % 3 <> 0"), _max_head)


def whole_scored_by_function(spark, sf):
    return _scored_whole(V.embed_patches(spark, sf), _mean_head)


def whole_scored_after_dropout(spark, sf):
    """A third of every bag is gone, all that is left is scored."""
    return _scored_whole(V.embed_patches(spark, sf).filter("patch_idx % 3 <> 0"), _mean_head)


def collected(spark, sf):
    """Predictions repeated by padded workers: one row per slide stays."""
    rows = V.predictions(spark, sf).select("slide_id", "label", "prob_1")
    repeated = rows.unionByName(rows.filter("label = 1"))
    return V.rounded(SC.collect_predictions(repeated))


def oof(spark, sf):
    rows = V.predictions(spark, sf)
    parts = [rows.filter(F.col("fold") == f).drop("fold") for f in range(5)]
    return V.rounded(SC.oof_predictions(parts))


def probe(spark, sf):
    """Folds stratified by the slides' labels, class by class in the result."""
    patches = V.embed_patches(spark, sf)
    labels = patches.groupBy("slide_id").agg(F.mode("label", True).alias("label"))
    vectors = P.pool_mean(patches).join(labels, "slide_id")
    name = F.col("slide_id").cast("string")
    manifest = labels.select(name.alias("slide_id"), name.alias("group_id"), F.col("label").cast("string").alias("label"))
    roles = SP.fold_roles(SP.kfold_split(manifest, 3), "kfold", 3).withColumn("slide_id", F.col("slide_id").cast("bigint"))
    out = S.linear_probe_cv(vectors, roles, 3).withColumn("t", PR.top_class("probs"))
    return out.select("fold", "slide_id", "label", F.size("probs").alias("n_classes"), "t.pred_class", F.round("t.pred_prob", 6).alias("pred_prob"))


def renormalized(spark, sf):
    rows = V.embed_patches(spark, sf).select(
        "slide_id", "patch_idx", F.transform("features", lambda v: F.greatest(F.round(v.cast("double"), 1), F.lit(0.0))).alias("p")
    )
    return _exploded(rows.withColumn("p", PR.renormalize_probs("p")), "p", "slide_id", "patch_idx")


def from_logits(spark, sf):
    """One, two or five logits per row by the row number."""
    rows = V.table(spark, sf, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5)), (F.col("vec_id") % 3 + 1).cast("int"))).cast("array<double>").alias("z")
    )
    return _exploded(rows.withColumn("p", PR.probs_from_logits("z")), "p", "vec_id")


def predicted(spark, sf):
    rows = V.predictions_multi(spark, sf)
    single = V.predictions(spark, sf).select(
        F.concat(F.lit("b"), F.col("slide_id").cast("string")).alias("id"), F.array("prob_1").alias("probs")
    )
    both = rows.select(F.concat(F.lit("m"), F.col("slide_id").cast("string")).alias("id"), "probs").unionByName(single)
    return both.select("id", PR.predict_class("probs", 0.4).alias("pred"))


def best_class(spark, sf):
    rows = V.predictions_multi(spark, sf).withColumn("t", PR.top_class("probs"))
    return V.rounded(rows.select("slide_id", "t.pred_class", "t.pred_prob"))


QUERIES = {
    "L1_pool_mean": mean_pool,
    "L1_pool_max": max_pool,
    "L2_patch_mlp": mlp,
    "L3_attention_logits": logits,
    "L4_attention_pool": pooled,
    "L5_multihead_attention_pool": multihead,
    "L6_classify": classified,
    "L7_score_bags": scored,
    "L7_score_bags_function": scored_by_function,
    "L7_score_after_dropout": scored_after_dropout,
    "L7_score_whole_bags_function": whole_scored_by_function,
    "L7_score_whole_after_dropout": whole_scored_after_dropout,
    "L8_collect_predictions": collected,
    "L9_oof_predictions": oof,
    "L10_linear_probe_cv": probe,
    "W11_bag_softmax": softmax,
    "P9_renormalize_probs": renormalized,
    "P10_probs_from_logits": from_logits,
    "P11_predict_class": predicted,
    "P12_top_class": best_class,
}


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _dense(vector: str, layer, wrap: str = "{}") -> str:
    """List expression of one dense layer."""
    parts = [wrap.format(f"(list_dot_product({vector}, {_list(w)}) + {float(b)!r}::DOUBLE)") for w, b in zip(*layer, strict=True)]
    return "[" + ", ".join(parts) + "]"


_MLP = f"hid AS (SELECT slide_id, patch_idx, {_dense('features', LAYER, 'greatest({}, 0.0::DOUBLE)')} AS h FROM v_embed)"


def _logit(head: S.Attention) -> str:
    tanh = _dense("h", head.tanh, "tanh({})")
    gate = _dense("h", head.gate, "(1.0::DOUBLE / (1.0::DOUBLE + exp(-{})))")
    weights, bias = head.out
    product = f"list_transform(list_zip({tanh}, {gate}), lambda p: p[1] * p[2])"
    return f"(list_dot_product({product}, {_list(weights[0])}) + {float(bias[0])!r}::DOUBLE)"


_LOGITS = f"{_MLP}, att AS (SELECT slide_id, patch_idx, h, {_logit(HEADS[0])} AS l0, {_logit(HEADS[1])} AS l1 FROM hid)"


def _att_pool(logit: str, name: str) -> str:
    return f"""
{name}_w AS (SELECT slide_id, h, exp({logit} - max({logit}) OVER (PARTITION BY slide_id)) AS w FROM att),
{name}_s AS (SELECT slide_id, i, sum(w * h[i]) / sum(w) AS v, count(*) AS n FROM {name}_w, range(1, {HIDDEN + 1}) t(i) GROUP BY 1, 2),
{name} AS (SELECT slide_id, max(n) AS n_patches, list(v ORDER BY i) AS e FROM {name}_s GROUP BY 1)"""


def _classify_sql(source: str, vector: str, head=HEAD) -> str:
    logits = _dense(vector, head)
    soft = "list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z)))))"
    cols = ", ".join([f"round(z[{c + 1}], 6) AS logit_{c}, round(p[{c + 1}], 6) AS prob_{c}" for c in range(CLASSES)])
    return f"""zz AS (SELECT slide_id, {logits} AS z FROM {source}), pp AS (SELECT *, {soft} AS p FROM zz)
SELECT slide_id, {cols}, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred_class, round(list_max(p), 6) AS pred_prob FROM pp"""


_POOL_SQL = """
SELECT slide_id, count(*) AS n_patches, CAST(i - 1 AS INT) AS pos, round({}(features[i]), 6) AS value FROM v_embed, range(1, 65) t(i) GROUP BY slide_id, i"""
def _bag_vector(aggregate: str, source: str = "v_embed") -> str:
    return f"""
m0 AS (SELECT slide_id, i, {aggregate}(features[i]) AS v FROM {source}, range(1, {DIM + 1}) t(i) GROUP BY 1, 2),
m AS (SELECT slide_id, list(v ORDER BY i) AS e FROM m0 GROUP BY 1)"""


_LEFT_OVER = "left_over AS (SELECT * FROM v_embed WHERE patch_idx % 3 <> 0)"
_WIDE = _classify_sql("m", "e", WIDE_HEAD)
_LINE_LOGIT = "lg AS (SELECT *, y / 64.0::DOUBLE + f2 * 10 AS logit FROM v_patches), wt AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY slide_id)) AS w FROM lg)"

ORACLES = {
    "L1_pool_mean": with_views("v_embed", _POOL_SQL.format("avg")),
    "L1_pool_max": with_views("v_embed", _POOL_SQL.format("max")),
    "L2_patch_mlp": with_views("v_embed", f"WITH {_MLP} SELECT slide_id, patch_idx, CAST(i - 1 AS INT) AS pos, round(h[i], 6) AS value FROM hid, range(1, {HIDDEN + 1}) t(i)"),
    "L3_attention_logits": with_views("v_embed", f"WITH {_LOGITS} SELECT slide_id, patch_idx, round(l0, 6) AS logit_0, round(l1, 6) AS logit_1, round((l0 + l1) / 2, 6) AS logit FROM att"),
    "L4_attention_pool": with_views("v_patches", f"""
WITH {_LINE_LOGIT}, e AS (SELECT slide_id, CAST(i AS INT) AS pos, w, CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS v FROM wt, range(4) t(i))
SELECT slide_id, count(*) AS n_patches, pos, round(sum(w * v) / sum(w), 6) AS value FROM e GROUP BY slide_id, pos"""),
    "L5_multihead_attention_pool": with_views("v_embed", f"""
WITH {_LOGITS}, {_att_pool("l0", "a")}, {_att_pool("l1", "b")},
j AS (SELECT slide_id, a.n_patches AS n_patches, list_concat(a.e, b.e) AS e FROM a JOIN b USING (slide_id)),
o AS (SELECT slide_id, n_patches, {_dense("e", PROJECTION)} AS e FROM j)
SELECT slide_id, n_patches, CAST(i - 1 AS INT) AS pos, round(e[i], 6) AS value FROM o, range(1, {HIDDEN + 1}) t(i)"""),
    "L6_classify": with_views("v_embed", f"WITH {_bag_vector('avg')}, {_WIDE}"),
    "L7_score_bags": with_views("v_embed", f"WITH {_LOGITS}, {_att_pool('l0', 'a')}, {_classify_sql('a', 'e')}"),
    "L7_score_bags_function": with_views("v_embed", f"WITH {_bag_vector('max')}, {_WIDE}"),
    "L7_score_after_dropout": with_views("v_embed", f"WITH {_LEFT_OVER}, {_bag_vector('max', 'left_over')}, {_WIDE}"),
    "L7_score_whole_bags_function": with_views("v_embed", f"WITH {_bag_vector('avg')}, {_WIDE}"),
    "L7_score_whole_after_dropout": with_views("v_embed", f"WITH {_LEFT_OVER}, {_bag_vector('avg', 'left_over')}, {_WIDE}"),
    "L8_collect_predictions": with_views("v_pred", "SELECT slide_id, label, round(prob_1, 6) AS prob_1 FROM v_pred"),
    "L9_oof_predictions": with_views("v_pred", "SELECT slide_id, patient_id, fold, label, round(prob_1, 6) AS prob_1 FROM v_pred"),
    "W11_bag_softmax": with_views("v_patches", f"WITH {_LINE_LOGIT} SELECT slide_id, patch_idx, round(w / sum(w) OVER (PARTITION BY slide_id), 9) AS attention FROM wt"),
    "P9_renormalize_probs": with_views("v_embed", """
WITH p AS (SELECT slide_id, patch_idx, list_transform(features, lambda v: greatest(round(v, 1), 0.0::DOUBLE)) AS p FROM v_embed),
s AS (SELECT *, list_sum(p) AS t FROM p)
SELECT slide_id, patch_idx, CAST(i - 1 AS INT) AS pos, round(p[i] / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS value FROM s, range(1, 65) t2(i)"""),
    "P10_probs_from_logits": """
WITH z AS (SELECT vec_id, list_transform(embedding[1:[1, 2, 5][CAST(vec_id % 3 + 1 AS INT)]], lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings),
e AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS p FROM z)
SELECT vec_id, CAST(0 AS INT) AS pos, round(1 / (1 + exp(-z[1])), 6) AS value FROM e WHERE len(z) = 1
UNION ALL SELECT vec_id, 0, round(p[2], 6) FROM e WHERE len(z) = 2
UNION ALL SELECT vec_id, CAST(i - 1 AS INT), round(p[i], 6) FROM e, range(1, 6) t(i) WHERE len(z) = 5""",
    "P11_predict_class": with_views("v_pred v_pred_multi", """
SELECT 'm' || CAST(slide_id AS VARCHAR) AS id, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred FROM v_pred_multi
UNION ALL SELECT 'b' || CAST(slide_id AS VARCHAR), CAST(CASE WHEN prob_1 >= 0.4::DOUBLE THEN 1 ELSE 0 END AS INT) FROM v_pred"""),
    "P12_top_class": with_views("v_pred_multi", "SELECT slide_id, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS pred_class, round(list_max(probs), 6) AS pred_prob FROM v_pred_multi"),
}
