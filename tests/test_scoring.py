import numpy as np
import pytest
from pyspark.sql import functions as F

from bagstats.operators import pooling as P
from bagstats.operators import scoring as S


def _layer(rng, out, into):
    return rng.normal(0, 0.5, (out, into)), rng.normal(0, 0.1, out)


@pytest.fixture(scope="module")
def bags(spark):
    rng = np.random.default_rng(5)
    data = {s: rng.normal(0, 1, (n, 6)) for s, n in enumerate([1, 7, 40])}
    rows = [(s, i, 0, i * 256, v.tolist()) for s, m in data.items() for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "slide_id int, patch_idx int, x int, y int, features array<double>")
    return data, df.repartition(9).cache()


def _vectors(df):
    return {r.slide_id: np.array(r.embedding) for r in df.collect()}


def test_mean_and_max(bags):
    data, df = bags
    mean, top = _vectors(P.pool_mean(df)), _vectors(P.pool_max(df))
    for s, m in data.items():
        assert np.allclose(mean[s], m.mean(0)) and np.allclose(top[s], m.max(0))


@pytest.mark.parametrize("scale", [1.0, 400.0])
def test_attention_pool_is_stable(bags, scale):
    data, df = bags
    rows = df.withColumn("logit", F.col("features")[0] * scale)
    got = _vectors(P.attention_pool(rows))
    soft = {(r.slide_id, r.patch_idx): r.attention for r in P.bag_softmax(rows).collect()}
    for s, m in data.items():
        z = m[:, 0] * scale
        w = np.exp(z - z.max())
        w /= w.sum()
        assert np.allclose(got[s], w @ m)
        assert np.allclose([soft[s, i] for i in range(len(m))], w)


def _forward(model, m):
    h = m
    for w, b in model.patch_layers:
        h = np.maximum(h @ w.T + b, 0)
    heads = []
    for a in model.attention:
        t = np.tanh(h @ a.tanh[0].T + a.tanh[1])
        if a.gate is not None:
            t = t / (1 + np.exp(-(h @ a.gate[0].T + a.gate[1])))
        z = (t @ a.out[0].T + a.out[1])[:, 0]
        w = np.exp(z - z.max())
        heads.append(w / w.sum() @ h)
    e = np.concatenate(heads)
    if model.projection is not None:
        e = model.projection[0] @ e + model.projection[1]
    z = model.head[0] @ e + model.head[1]
    p = np.exp(z - z.max())
    return e, z, p / p.sum()


@pytest.mark.parametrize("heads", [1, 3])
def test_score_bags_against_numpy(bags, heads):
    data, df = bags
    rng = np.random.default_rng(6)
    attention = [S.Attention(_layer(rng, 4, 5), _layer(rng, 1, 4), _layer(rng, 4, 5) if i % 2 == 0 else None) for i in range(heads)]
    projection = _layer(rng, 5, 5 * heads) if heads > 1 else None
    model = S.BagModel(_layer(rng, 2, 5), [_layer(rng, 5, 6)], attention, projection)
    for row in S.score_bags(df, model).collect():
        e, z, p = _forward(model, data[row.slide_id])
        assert np.allclose(row.embedding, e) and np.allclose(row.logits, z) and np.allclose(row.probabilities, p)
        assert row.pred_class == int(p.argmax()) and row.n_patches == len(data[row.slide_id])
    with pytest.raises(Exception, match="expected 6 features"):
        S.score_bags(df.withColumn("features", F.slice("features", 1, 5)), model).collect()


def test_predict_function(bags):
    data, df = bags

    def predict(bag):
        return {"embedding": bag.mean(axis=0), "logits": [bag.shape[0], 0.0]}

    got = {r.slide_id: r for r in S.score_bags(df, predict, max_instances=10).collect()}
    assert got[2].logits[0] == 10 and np.allclose(got[2].embedding, data[2][:10].mean(0))
    with pytest.raises(ValueError, match="max_instances"):
        S.score_bags(df, predict)


def test_pooler_registry():
    assert P.get_pooler("mean") is P.pool_mean
    with pytest.raises(ValueError, match="Available"):
        P.get_pooler("nope")
    with pytest.raises(ValueError, match="already"):
        P.register_pooler("mean")(P.pool_mean)


def test_linear_probe_learns(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 90)
    x = rng.normal(0, 1, (90, 3)) + y[:, None] * 2
    data = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "slide_id int, label int, embedding array<double>")
    roles = data.select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("fold"))
    roles = roles.withColumn("role", F.when(F.col("slide_id") % 2 == F.col("fold"), "val").otherwise("train"))
    out = S.linear_probe_cv(data, roles, 2).toPandas()
    assert sorted(out.slide_id) == list(range(90))
    assert (out.probs.map(np.argmax) == out.label).mean() > 0.9
