import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagstats.llm import cross_polytope
from bagstats.llm.cross_polytope import hadamard, nearest


def _exact(vectors, ids, query, k):
    scores = vectors @ vectors[query]
    scores[ids == ids[query]] = -np.inf
    best = np.lexsort((ids, -scores))[:k]
    return [int(ids[b]) for b in best if scores[b] > -np.inf], scores


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(0).normal(size=(5, 16))
    assert np.linalg.norm(hadamard(rows), axis=1) == pytest.approx(np.linalg.norm(rows, axis=1))
    assert hadamard(hadamard(rows)) == pytest.approx(rows)


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 4)])
def test_recall_on_the_table(spark, sf, monkeypatch, blocks):
    monkeypatch.setattr(cross_polytope, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", blocks[1])
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = table.toPandas()
    ids, vectors = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    found = nearest(table, F.col("vec_id") % 20 == 0, k=20).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        best, scores = _exact(vectors, ids, q, 20)
        mine = found[found.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, [scores[ids == v][0] for v in mine.vec_id], atol=1e-12)
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + len(best)
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (9, [math.inf, 1.0]),
            (5, [100.0, 1.0]), (6, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, length double, axis int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table, F.col("vec_id") % 20 == 0, k=3, probes=4).collect()]
    assert sorted(got) == [(0, 1, 5, 102.0), (0, 2, 6, 5.0), (0, 3, 20, 3.0), (20, 1, 5, 300.0), (20, 2, 0, 3.0), (20, 3, 6, 3.0)]
    assert nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_all_candidates_if_fewer_than_asked(spark):
    table = spark.createDataFrame([(k * 20, [1.0, float(k)]) for k in range(4)], "vec_id long, embedding array<float>")
    assert nearest(table, F.lit(True), k=20, probes=4).count() == 12


def _recall(spark, ids, vectors, asks, k=20):
    """Share of the true neighbours found at production parameters; ranks, scores and the number of rows must be right."""
    table = spark.createDataFrame([(int(i), [float(x) for x in v], bool(a)) for i, v, a in zip(ids, vectors, asks)], "vec_id long, embedding array<float>, asks boolean")
    found = nearest(table, F.col("asks"), k=k).toPandas()
    hits = total = 0
    for q in np.flatnonzero(asks):
        best, scores = _exact(vectors, ids, q, k)
        mine = found[found.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(best) + 1))
        assert np.allclose(mine.score, [scores[ids == v].max() for v in mine.vec_id], rtol=1e-12)
        hits, total = hits + len(set(best) & set(mine.vec_id)), total + len(best)
    assert len(found) == total
    return hits / total


@pytest.mark.parametrize("kind", ["one of 1.01", "one of 10", "three lengths", "within 4 percent", "spread"])
@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_with_unequal_lengths(spark, kind, size):
    data = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").toPandas()
    ids, vectors = data.vec_id.to_numpy(), np.stack(data.embedding)
    rng, n = np.random.default_rng(3), len(ids)
    one = np.where(np.arange(n) == 7, 1, 0)
    lengths = {
        "one of 1.01": 1 + 0.01 * one, "one of 10": 1 + 9 * one, "three lengths": rng.choice([1.0, 1.5, 3.0], n),
        "within 4 percent": rng.uniform(1, 1.04, n), "spread": rng.lognormal(0, 0.5, n),
    }[kind]
    vectors = (vectors * lengths[:, None]).astype(np.float32).astype(float)
    assert _recall(spark, ids, vectors, ids % 20 == 0) >= 0.9


def test_fewer_candidates_than_asked_at_production_parameters(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(15, 64)) * rng.uniform(0.1, 10, (15, 1))).astype(np.float32).astype(float)
    assert _recall(spark, np.arange(15), vectors, np.arange(15) % 3 == 0) == 1


def test_queries_far_from_all_tables_entries_search_everything(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=64)
    vectors = middle + 0.02 * rng.normal(size=(600, 64))
    vectors[0] = -middle
    vectors = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32).astype(float)
    assert _recall(spark, np.arange(600), vectors, np.arange(600) == 0) == 1


def test_many_vectors_of_one_id_do_not_push_out_others(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [5.0, k / 10]) for k in range(30)] + [(2, [1.0, 1.0]), (3, [0.5, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in nearest(table, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [(1, 5.0), (2, 1.0), (3, 0.5)]
