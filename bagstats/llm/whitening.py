"""Embedding whitening by incremental eigendecomposition.

A partition holds the eigenvalues and eigenvectors of the centred scatter of the rows it has seen.  A block of rows is
brought to its triangular factor, whose rows are as many vectors as there are dimensions at most, and each of
them is a rank-one update: the new eigenvalues are the roots of the secular equation, found all at once
between the old ones, after entries without weight and equal eigenvalues are deflated.  One more update moves
the centre.  The partitions' spectra are combined in a tree, by successive rank-one updates with the eigenvectors of
one side scaled by the roots of their eigenvalues, again with one for the centre.  As sums and counts are
integers, the mean is exact.

The basis found this way is refined in one distributed Rayleigh-Ritz step: rows, centred by the exact mean, are projected on
it, the projected scatter is added up and diagonalised.  A last pass measures the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bagstats.llm.vectors import is_finite, matrix, of_one_length
from bagstats.sources.shared import written

FAN_IN = 16  # partial results that are combined at a time
BLOCK_BYTES = 32 << 20
EPS = np.finfo(float).eps
_LONG = 2**63


# --- rank-one updates -------------------------------------------------------


def _roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z^2 / (poles - x))``, one above each of the rising poles: (poles less the origin of each root, root less origin).

    The origin is the pole nearest to the root, so that differences to it lose nothing.  Each step fits a
    rational function with the two poles beside the root; where that leaves the bracket, the bracket is halved.
    """
    count = len(poles)
    squares = z * z
    total = squares.sum()
    right = np.append(poles[1:], poles[-1] + total)
    middle = (right - poles) / 2
    value = 1 + (squares / ((poles[None, :] - poles[:, None]) - middle[:, None])).sum(1)
    upper = value < 0  # the root is in the upper half: its origin is the next pole
    upper[-1] = False
    origin = np.where(upper, right, poles)
    delta = poles[None, :] - origin[:, None]
    low = np.where(upper, -middle, 0.0)
    high = np.where(upper, 0.0, middle)
    if value[-1] < 0:
        low[-1], high[-1] = middle[-1], 2 * middle[-1]
    x = (low + high) / 2
    below = np.tri(count, dtype=bool)  # poles up to the root's own
    row = np.arange(count)
    beside = np.append(delta[row[:-1], row[1:]], right[-1] - origin[-1])
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gap = delta - x[:, None]
            terms = squares / gap
            f = 1 + terms.sum(1)
            done = ~(np.abs(f) > 4 * EPS * count * (1 + np.abs(terms).sum(1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            high, low = np.where(f > 0, x, high), np.where(f <= 0, x, low)
            slopes = terms / gap
            left, rest = np.where(below, slopes, 0.0).sum(1), np.where(below, 0.0, slopes).sum(1)
            one, two = delta[row, row] - x, beside - x
            c = f - one * left - two * rest
            a = (one + two) * f - one * two * (left + rest)
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            fresh = x + step
        outside = ~((fresh > low) & (fresh < high))
        x = np.where(done, x, np.where(outside, (low + high) / 2, fresh))
    return delta, x


def rank_one(values: np.ndarray, axes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``axes * values * axes' + v v'``."""
    z = axes.T @ v
    length = np.sqrt(z @ z)
    if not length:
        return values, axes
    scale = max(abs(values[-1]), abs(values[0]), length * length)
    kept = np.abs(z) * length > 8 * EPS * scale
    if not kept.any():
        return values, axes
    axes, values = axes.copy(), values.copy()
    # Deflation: of two eigenvalues that are equal within rounding, a rotation gives all the weight to the second.
    active: list[int] = []
    for k in np.flatnonzero(kept).tolist():
        if active:
            j = active[-1]
            r = np.hypot(z[j], z[k])
            c, s = z[k] / r, z[j] / r
            if abs((values[k] - values[j]) * c * s) <= 8 * EPS * scale:
                z[k], z[j] = r, 0.0
                first, second = axes[:, j].copy(), axes[:, k].copy()
                axes[:, j], axes[:, k] = c * first - s * second, s * first + c * second
                one, two = values[j], values[k]
                values[j], values[k] = one * c * c + two * s * s, one * s * s + two * c * c
                active.pop()
        active.append(k)
    at = np.array(active)
    at = at[np.argsort(values[at], kind="stable")]
    poles, weights = values[at], z[at]
    if len(at) == 1:
        values[at] = poles + weights * weights
    else:
        delta, x = _roots(poles, weights)
        gap = delta - x[:, None]  # poles less roots, a row for each root
        count = len(at)
        apart = poles[None, :] - poles[:, None]  # [k, i]: pole i less pole k
        # The weights for which these very roots are exact: with them the eigenvectors come out orthogonal.
        ratios = np.empty((count, count))
        lower = np.tri(count, k=-1, dtype=bool).T  # root k below pole i
        ratios[lower] = (gap / np.where(apart == 0, 1, apart))[lower]
        shifted = np.vstack([apart[1:], -np.ones(count)])
        ratios[~lower] = (gap / np.where(shifted == 0, 1, shifted))[~lower]
        exact = np.sqrt(np.abs(ratios.prod(0))) * np.sign(weights)
        turn = exact[:, None] / gap.T
        turn /= np.sqrt((turn * turn).sum(0))
        axes[:, at] = axes[:, at] @ turn
        values[at] = poles + np.diagonal(-gap)
    order = np.argsort(values, kind="stable")
    return values[order], axes[:, order]


@dataclass
class Spectrum:
    """Rows seen, their exact sums, and the eigendecomposition of their centred scatter."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, [0] * dim, np.zeros(dim), np.eye(dim))

    def _mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def _joined(self, n: int, sums: list[int], vectors: np.ndarray) -> None:
        """Add ``n`` rows whose centred scatter is that of ``vectors``."""
        for v in vectors:
            self.values, self.axes = rank_one(self.values, self.axes, v)
        if self.n and n:
            shift = np.array([s / n for s in sums]) - self._mean()
            self.values, self.axes = rank_one(self.values, self.axes, shift * np.sqrt(self.n / (self.n + n) * n))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def add(self, block: np.ndarray) -> None:
        """Rows of integers."""
        sums = _exact_sums(block)
        centred = block - np.array([s / len(block) for s in sums])
        self._joined(len(block), sums, np.linalg.qr(centred, mode="r"))

    def combine(self, other: Spectrum) -> None:
        used = other.values > 0
        self._joined(other.n, other.sums, (other.axes[:, used] * np.sqrt(other.values[used])).T)


def _exact_sums(block: np.ndarray) -> list[int]:
    if len(block) and int(np.abs(block).max()) * len(block) >= _LONG:
        return [int(s) for s in block.astype(object).sum(0)]
    return [int(s) for s in block.sum(0)]


# --- partial results --------------------------------------------------------


def _combined(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One partial result of all, combined on the executors ``FAN_IN`` at a time; each level is written."""

    def level(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by("part").column("data").to_pylist()
        number = rows.column("group")[0].as_py()
        return pa.table({"part": pa.array([number], pa.int64()), "data": pa.array([merge(ordered)], pa.binary())})

    parts = written(parts, "partial")
    while parts.count() > 1:
        grouped = parts.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("group")
        parts = written(grouped.applyInArrow(level, "part long, data binary"), "partial")
    row = parts.first()
    return bytes(row.data) if row else None


def _per_task(rows: DataFrame, work: Callable[[Iterator[np.ndarray]], bytes | None], dim: int) -> DataFrame:
    """``part, data`` of every task that has rows: what ``work`` makes of its blocks."""
    block = max(dim, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                values = matrix(batch.column(0), dim)
                for at in range(0, len(values), block):
                    yield values[at : at + block]

        data = work(blocks())
        if data is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["part", "data"])

    return rows.select("x").mapInArrow(run, "part long, data binary")


def _pack(spectrum: Spectrum) -> bytes:
    numbers = ",".join(str(k) for k in [spectrum.n, *spectrum.sums]).encode()
    return len(numbers).to_bytes(8, "big") + numbers + spectrum.values.tobytes() + np.ascontiguousarray(spectrum.axes).tobytes()


def _unpack(data: bytes) -> Spectrum:
    end = 8 + int.from_bytes(data[:8], "big")
    n, *sums = (int(k) for k in data[8:end].split(b","))
    floats = np.frombuffer(data[end:])
    dim = len(sums)
    return Spectrum(n, sums, floats[:dim].copy(), floats[dim:].reshape(dim, dim).copy())


def _add(parts: list[bytes]) -> bytes:
    return sum(np.frombuffer(p) for p in parts).tobytes()


# --- the operator -----------------------------------------------------------


@dataclass
class Whitening:
    """Exact count and sums, components as columns by falling eigenvalue, and the eigenvalues of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, block: np.ndarray) -> np.ndarray:
        """``n * x - sum``, exact: 64-bit integers, or Python's where these do not suffice."""
        most = int(np.abs(block).max()) if len(block) else 0
        if self.n * (most + 1) + max(abs(s) for s in self.sums) < _LONG:
            return block * np.int64(self.n) - np.array(self.sums, np.int64)
        return block.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, block: np.ndarray) -> np.ndarray:
        return (self.deviations(block) / self.n).astype(float)

    def varying(self) -> np.ndarray:
        """Components that have variance beyond rounding."""
        return self.eigenvalues > len(self.sums) * EPS * max(self.trace, 0.0)


def fit_whitening(rows: DataFrame, dim: int) -> Whitening | None:
    """Fit over the integer vectors ``x`` of all rows, each of ``dim`` entries; None for an empty table."""

    def spectrum(blocks: Iterator[np.ndarray]) -> bytes | None:
        found = Spectrum.empty(dim)
        for block in blocks:
            found.add(block)
        return _pack(found) if found.n else None

    def merge(parts: list[bytes]) -> bytes:
        whole, *rest = (_unpack(p) for p in parts)
        for part in rest:
            whole.combine(part)
        return _pack(whole)

    data = _combined(_per_task(rows, spectrum, dim), merge)
    if data is None:
        return None
    found = _unpack(data)
    basis = np.linalg.qr(found.axes[:, ::-1])[0]
    start = Whitening(found.n, found.sums, basis, found.values[::-1], 0.0)

    def projected(blocks: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for block in blocks:
            seen = start.centred(block) @ basis
            total = seen.T @ seen + (0 if total is None else total)
        return None if total is None else total.tobytes()

    scatter = np.frombuffer(_combined(_per_task(rows, projected, dim), _add)).reshape(dim, dim) / found.n
    values, turn = np.linalg.eigh((scatter + scatter.T) / 2)
    components = basis @ turn[:, ::-1]
    largest = np.abs(components).argmax(0)
    components = components * np.where(components[largest, np.arange(dim)] < 0, -1.0, 1.0)
    return Whitening(found.n, found.sums, components, values[::-1], float(np.trace(scatter)))


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "x",
    components: int = 8,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Vectors hold integers.  The fit is over all vectors, with divisor ``n``; components are numbered from 1 by falling
    eigenvalue, the sign such that the largest entry is positive.  ``deviation`` is the exact sum of ``(n * x - sum)^2`` (null if it
    passes 64 bits, which takes some hundred thousand rows of wide spread), ``explained`` the eigenvalue's share of
    the trace, ``identity_error`` the largest entry of the whitened rows' covariance less the identity, measured on all rows.
    A component without variance has a null ``whitened`` and is left out of ``identity_error``; without any
    variance ``explained`` is null too.  Null or empty vectors, null components and other lengths than most take no part;
    null ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<bigint>").alias("x"))
    rows, dim = of_one_length(rows.filter(is_finite(F.col("x"))), "x")
    rest = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType([StructField("vec_id", vectors.schema[id_col].dataType), *StructType.fromDDL(rest).fields])
    fit = fit_whitening(rows, dim) if dim else None
    if fit is None:
        return spark.createDataFrame([], schema)
    count = min(components, dim)
    varying = fit.varying()[:count]
    scale = np.where(varying, np.sqrt(np.where(varying, fit.eigenvalues[:count], 1.0)), np.nan)
    turn = fit.components[:, :count]

    def moments(blocks: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for block in blocks:
            white = (fit.centred(block) @ turn) / scale
            part = np.concatenate([white.sum(0), (white.T @ white).ravel()])
            total = part if total is None else total + part
        return None if total is None else total.tobytes()

    measured = np.frombuffer(_combined(_per_task(rows, moments, dim), _add)) / fit.n
    mean, square = measured[:count], measured[count:].reshape(count, count)
    error = np.abs(square - np.outer(mean, mean) - np.eye(count))[np.ix_(varying, varying)]
    identity_error = float(error.max()) if error.size else 0.0
    explained = fit.eigenvalues[:count] / fit.trace if fit.trace > 0 else np.full(count, np.nan)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                size = part.num_rows
                block = matrix(part.column(1), dim)
                deviations = fit.deviations(block)
                white = ((deviations / fit.n).astype(float) @ turn) / scale
                if deviations.dtype != object and size and int(np.abs(deviations).max()) ** 2 * dim >= _LONG:
                    deviations = deviations.astype(object)
                squares = [int(s) if s < _LONG else None for s in (deviations * deviations).sum(1)]
                places = pa.array(np.repeat(np.arange(size), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(places), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * count, fit.n)), pa.array(squares, pa.int64()).take(places),
                        pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, size), from_pandas=True),
                        pa.array(np.full(size * count, identity_error)),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(whitened, schema)
