import numpy as np
import pytest

from bagstats.llm import whitening
from bagstats.llm.whitening import Spectrum, rank_one, whiten

SHAPE = "vec_id long, x array<long>"


def _exact(rows, count):
    """Reference by a dense eigendecomposition: sums, deviations, eigenvalues, whitened values."""
    x = np.array([r[1] for r in rows], np.int64)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    with np.errstate(divide="ignore", invalid="ignore"):
        white = centred @ axes / np.sqrt(values)
    return ((n * x - sums).astype(object) ** 2).sum(1), values / (centred**2).sum() * n, white


def _compare(spark, rows, count=8, **tolerance):
    table = spark.createDataFrame(rows, SHAPE).repartition(3)
    found = whiten(table, components=count).toPandas().sort_values(["vec_id", "component"])
    deviations, shares, white = _exact(rows, count)
    width = white.shape[1]
    assert len(found) == len(rows) * width and set(found.n) == {len(rows)}
    assert found.deviation.tolist() == [int(d) for d in np.repeat(deviations, width)]
    got = found.whitened.to_numpy().reshape(len(rows), width)
    assert found.explained.to_numpy()[:width] == pytest.approx(shares, rel=1e-9)
    signs = np.sign((got * white).sum(0))
    assert got == pytest.approx(white * signs, **(tolerance or {"rel": 1e-7, "abs": 1e-8}))
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


@pytest.mark.parametrize("kind", range(5))
def test_rank_one_updates(kind):
    """Spread, equal, graded, zero and nearly equal eigenvalues; vectors with zeros and along an axis."""
    rng = np.random.default_rng(kind)
    for trial in range(60):
        dim = int(rng.integers(1, 40))
        values = np.sort([rng.random(dim), np.round(4 * rng.random(dim)), 10.0 ** rng.uniform(-12, 3, dim), np.zeros(dim), 1 + 1e-13 * rng.random(dim)][kind])
        axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        v = rng.normal(size=dim) * 10.0 ** rng.uniform(-8, 4)
        if trial % 3 == 0:
            v[rng.random(dim) < 0.5] = 0
        if trial % 7 == 0:
            v = axes[:, 0] * 2.0
        wanted = axes @ np.diag(values) @ axes.T + np.outer(v, v)
        fresh, turned = rank_one(values, axes, v)
        assert (np.diff(fresh) >= 0).all()
        assert turned.T @ turned == pytest.approx(np.eye(dim), abs=1e-12)
        assert turned @ np.diag(fresh) @ turned.T == pytest.approx(wanted, abs=1e-12 * max(np.abs(wanted).max(), 1e-300))


def test_partitions_combine_to_the_whole():
    rng = np.random.default_rng(8)
    rows = (rng.normal(size=(700, 9)) * np.arange(1, 10) * 50).astype(np.int64) + 100_000
    parts = []
    for begin, end in ((0, 3), (3, 4), (4, 400), (400, 700)):
        part = Spectrum.empty(9)
        for at in range(begin, end, 64):
            part.add(rows[at : min(at + 64, end)])
        parts.append(whitening._unpack(whitening._pack(part)))
    whole = Spectrum.empty(9)
    for part in parts:
        whole.combine(part)
    centred = rows - rows.mean(0)
    assert whole.n == 700 and whole.sums == [int(s) for s in rows.sum(0)]
    assert whole.axes @ np.diag(whole.values) @ whole.axes.T == pytest.approx(centred.T @ centred, rel=1e-9, abs=1e-3)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_agrees_with_a_dense_decomposition(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 200
    _compare(spark, [(k, [int(c) for c in r]) for k, r in enumerate(mixed + 100_000)])


def test_table(spark, sf):
    from bagstats.llm.queries import op12_whitening

    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in zip(data.vec_id, data.embedding, strict=True)]
    _compare(spark, rows)
    found = op12_whitening(spark, sf).toPandas()
    assert len(found) == 8 * len(rows) and found.identity_error.max() < 1e-9 and not found.isna().any().any()


def test_large_values_are_exact(spark):
    """Deviations beyond 64 bits are null and all others exact."""
    rows = [(k, [k * 10**7, -k, 5]) for k in range(40)]
    table = spark.createDataFrame(rows, SHAPE)
    found = {r.vec_id: r.deviation for r in whiten(table, components=1).collect()}
    deviations = _exact(rows, 1)[0]
    assert found == {k: int(d) if d < 2**63 else None for k, d in enumerate(deviations)}
    assert None in found.values() and sum(v is not None for v in found.values()) > 5


def test_odd_rows(spark):
    """Nulls, other lengths, repeated rows, fewer dimensions than components, no variance, and no rows at all."""
    rng = np.random.default_rng(6)
    rows = [(k, [int(c) for c in rng.integers(0, 50, 3)]) for k in range(30)]
    _compare(spark, [*rows, (30, rows[0][1]), (31, rows[0][1])])
    odd = [(100, None), (101, []), (102, [1, None, 3]), (103, [1, 2]), (None, rows[3][1])]
    table = spark.createDataFrame([*rows, *odd], SHAPE).selectExpr("*", "1 AS n", "2 AS component", "3 AS part", "4 AS data")
    found = whiten(table).toPandas()
    assert len(found) == 3 * 31 and set(found.n) == {31} and found.vec_id.isna().sum() == 3
    flat = whiten(spark.createDataFrame([(1, [4, 4]), (2, [4, 4])], SHAPE)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(0, None, None, 0.0)] * 4
    line = whiten(spark.createDataFrame([(k, [k, 2 * k]) for k in range(5)], SHAPE)).toPandas()
    assert line[line.component == 2].whitened.isna().all() and not line[line.component == 1].whitened.isna().any()
    assert line[line.component == 1].explained.to_numpy() == pytest.approx(1.0)
    assert whiten(spark.createDataFrame([], SHAPE)).count() == 0
