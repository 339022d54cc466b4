"""Resampling weights as vectors: all repeats of a bootstrap in one pass, without a row per repeat.

A unit has one weight per repeat, Poisson distributed with mean 1 and drawn from a hash of (seed, unit, repeat), or the
number of times it came up in n draws of n units (``drawn_weights``), which stand beside the rows as bytes.  A task
holds, for the rows it reads, one array with an entry per repeat instead of the rows' copies:

* confusion counts are such an array per (label, prediction), summed inside each input partition and then
  added on the map side again, so what is shuffled grows with classes and partitions and not with rows;
* for the area under the ROC curve rows are sorted by score over ranges, and a task keeps running arrays of positives,
  negatives and area.  The ranges' arrays, cut into chunks of repeats, are added up in order.  Equal scores may lie in several
  ranges, so that a score of very many rows is no task of its own: the first and last score of each range are
  passed on, and pairs between them are corrected to one half.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bagstats.functions.keys import hash_key, uniform
from bagstats.functions.spread import spread_out

# An odd increment, and the multipliers of the 32-bit finaliser of MurmurHash3.
STEP, FIRST, SECOND = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
CELLS = 1 << 20  # weights held at a time: rows times repeats
PIECE = 1 << 16  # weights drawn at a time, so that they stay in a core's cache
ROWS = 1 << 18  # weights turned into rows at a time
HELD = 4 << 20  # sums held at a time: cells times repeats, or draws
CHUNK = 64  # repeats whose ranges are added up together


def _thresholds() -> list[int]:
    """32-bit numbers from which a weight is at least 1, 2, ... (the Poisson quantile, cut where 32-bit numbers end)."""
    total, out = 0.0, []
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(math.ceil(total * 2.0**32))
    return [t for t in out if t < 2**32]


THRESHOLDS = _thresholds()
# Weight by the upper half of a number; where a threshold lies inside such a step, the whole number is compared.
_STEPS = np.searchsorted(np.array(THRESHOLDS), np.arange(1 << 16) << 16, side="right").astype(np.uint8)
_INSIDE = np.zeros(1 << 16, bool)
_INSIDE[[t >> 16 for t in THRESHOLDS]] = True


def unit_key(seed: int, unit: str | Column) -> Column:
    """Two 32-bit halves that name a unit in its draws."""
    digest = hash_key(seed, unit)
    halves = [F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") for start in (1, 9)]
    return F.struct(halves[0].alias("high"), halves[1].alias("low"))


def _keys(column: pa.StructArray) -> np.ndarray:
    high, low = (column.field(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in (0, 1))
    return high << np.uint64(32) | low


def _scrambled(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, one to one."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def poisson_weights(keys: np.ndarray, n_repeats: int) -> np.ndarray:
    """Weights (units x repeats) of 64-bit unit keys."""
    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    steps = np.arange(1, n_repeats + 1, dtype=np.uint32) * np.uint32(STEP)
    out = np.empty((len(keys), n_repeats), np.uint8)
    limits = np.array(THRESHOLDS, np.uint32)
    rows = max(1, PIECE // n_repeats)
    for at in range(0, len(keys), rows):
        x = _scrambled(low[at : at + rows, None] + steps)
        x ^= high[at : at + rows, None]
        x = _scrambled(x)
        upper = (x >> np.uint32(16)).astype(np.uint16)
        part = _STEPS[upper]
        near = np.nonzero(_INSIDE[upper])
        part[near] = np.searchsorted(limits, x[near], side="right")
        out[at : at + rows] = part
    return out


def _weights(column: pa.Array, n_repeats: int) -> Callable[[slice | np.ndarray], np.ndarray]:
    """Weights (units x repeats) of some rows of a batch, from unit keys or from numbers that stand there as bytes."""
    if pa.types.is_struct(column.type):
        keys = _keys(column)
        return lambda at: poisson_weights(keys[at], n_repeats)
    held = column.to_pylist()

    def of(at: slice | np.ndarray) -> np.ndarray:
        found = held[at] if isinstance(at, slice) else [held[k] for k in at]
        return np.stack([np.frombuffer(v, np.uint8 if len(v) == n_repeats else "<u4") for v in found])

    return of


def drawn_weights(units: DataFrame, by: Sequence[str], seed: int, n_repeats: int) -> DataFrame:
    """``by, unit_no, __unit`` of n draws of n units per repeat: how often a unit came up in each, as bytes.

    ``units`` has ``by, unit_no, n_units``.  A draw is a keyed hash of (repeat, draw number).  Tasks pack the draws of a block
    of units into bytes, four for a draw, and a block is counted where its packets meet.  Units that never come up are left out.
    """
    by = list(by)
    block = max(1, CELLS // n_repeats)
    number = F.floor(uniform(seed, "b", "unit_no") * F.col("n_units"))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    draws = spread_out(units.select(*by, "unit_no", "n_units"), "unit_no").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    draws = draws.select(*by, group.alias("__group"), number.alias("number"), "b")
    kinds = units.select(*by).schema.fields
    schema = StructType([*kinds, *StructType.fromDDL("block long, draws binary").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packets() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            name = table.column("__group").combine_chunks().dictionary_encode()
            name = (name if isinstance(name, pa.DictionaryArray) else pa.concat_arrays(name.chunks)).indices.to_numpy()
            unit, b = (table.column(c).to_numpy() for c in ("number", "b"))
            order = np.lexsort((unit, name))
            name, place = name[order], (unit // block)[order]
            starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1])]))
            codes = (unit % block * n_repeats + b)[order].astype("<u4")
            offsets = np.append(starts, len(codes)).astype(np.int32) * 4
            binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])
            lead = table.select(by).take(pa.array(order[starts])).combine_chunks()
            lead = [pa.concat_arrays(c.chunks) for c in lead.columns]
            return pa.RecordBatch.from_arrays([*lead, pa.array(place[starts], pa.int64()), binary], names=schema.names)

        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= HELD:
                yield packets()
                count = 0
        if held:
            yield packets()

    out = StructType([*kinds, *StructType.fromDDL("unit_no long, __unit binary").fields])

    def tally(table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table.column("draws").to_pylist()), "<u4")
        counts = np.bincount(codes, minlength=block * n_repeats).reshape(block, n_repeats)
        there = np.flatnonzero(counts.any(axis=1))
        packed = [row.astype(np.uint8 if row.max() < 256 else "<u4").tobytes() for row in counts[there]]
        first = table.column("block")[0].as_py() * block + 1
        lead = [table.column(c).combine_chunks().take(pa.array([0] * len(there))) for c in by]
        lead = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in lead]
        return pa.table([*lead, pa.array(there + first, pa.int64()), pa.array(packed, pa.binary())], names=out.names)

    return draws.mapInArrow(pack, schema).groupBy(*by, "block").applyInArrow(tally, out)


def weighted_rows(cells: DataFrame, n_repeats: int, unit: str = "__unit", count: str = "n") -> DataFrame:
    """A row per cell and repeat in which its unit has a weight, with ``b`` and ``count`` times the weight.

    For metrics that need rows of their own; the two functions below need none.
    """
    kept = [c for c in cells.columns if c != unit]
    schema = StructType([StructField("b", StructType.fromDDL("b int").fields[0].dataType), *cells.select(*kept).schema.fields])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = _weights(batch.column(batch.num_columns - 1), n_repeats)
            for at in range(0, batch.num_rows, max(1, ROWS // n_repeats)):
                weights = of(slice(at, at + max(1, ROWS // n_repeats))).astype(np.int64)
                row, repeat = np.nonzero(weights)
                part = batch.take(pa.array(row + at))
                numbers = part.column(kept.index(count)).to_numpy(zero_copy_only=False) * weights[row, repeat]
                columns = [pa.array(numbers, pa.int64()) if c == count else part.column(k) for k, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays([pa.array(repeat, pa.int32()), *columns], names=["b", *kept])

    return cells.select(*kept, unit).mapInArrow(draw, schema)


def confusion_draws(rows: DataFrame, by: Sequence[str], n_repeats: int) -> DataFrame:
    """``by, b, label, pred, n`` of every repeat, from rows with ``label, pred, __unit`` that stand for ``__times`` rows, if there is such a column."""
    by = list(by)
    columns = [*by, "label", "pred"]
    times = ["__times"] if "__times" in rows.columns else []
    kinds = rows.select(*columns).schema.fields
    schema = StructType([*kinds, *StructType.fromDDL("w array<double>").fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, pa.RecordBatch] = {}

        def pack() -> pa.RecordBatch:
            table = pa.Table.from_batches(list(seen.values())).combine_chunks()
            values = pa.array(np.concatenate(list(sums.values())))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * n_repeats, pa.int32()), values)
            out = pa.RecordBatch.from_arrays([*[pa.concat_arrays(c.chunks) for c in table.columns], lists], names=[*columns, "w"])
            sums.clear()
            seen.clear()
            return out

        for batch in batches:
            cell = batch.column(len(columns)).dictionary_encode()
            names, code = cell.dictionary.to_pylist(), cell.indices.to_numpy()
            of = _weights(batch.column(len(columns) + 1), n_repeats)
            factor = batch.column(len(columns) + 2).to_numpy().astype(float) if times else None
            order = np.argsort(code, kind="stable")
            first = np.searchsorted(code[order], np.arange(len(names)))
            for k, name in enumerate(names):
                if name not in sums:
                    if (len(sums) + 1) * n_repeats > HELD:
                        yield pack()
                    sums[name] = np.zeros(n_repeats)
                    seen[name] = batch.slice(int(order[first[k]]), 1).select(columns)
                own = order[first[k] : first[k + 1] if k + 1 < len(names) else None]
                for at in range(0, len(own), max(1, CELLS // n_repeats)):
                    part = own[at : at + max(1, CELLS // n_repeats)]
                    sums[name] += of(part).sum(0, dtype=np.int64) if factor is None else factor[part] @ of(part)
        if sums:
            yield pack()

    named = rows.select(*columns, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("__cell"), "__unit", *times)
    parts = named.mapInArrow(add, schema)
    whole = parts.groupBy(*columns).agg(Summarizer.sum(array_to_vector("w")).alias("w"))
    # The summary keeps means: their sums are whole numbers again after rounding.
    long = whole.select(*columns, F.posexplode(vector_to_array("w")).alias("b", "n")).withColumn("n", F.round("n").cast("bigint"))
    return long.filter("n > 0")


class _Ranged:
    """Running arrays of one group inside one range: rows come in the order of their scores."""

    def __init__(self, row: pa.RecordBatch, n_repeats: int):
        self.row = row
        self.pos, self.neg, self.area = (np.zeros(n_repeats) for _ in range(3))
        self.score: float | None = None  # the score whose rows are still coming
        self.open = [np.zeros(n_repeats), np.zeros(n_repeats)]
        self.first: tuple[float, np.ndarray, np.ndarray] | None = None

    def feed(self, scores: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
        begin, end = (int(starts[1]) if len(starts) > 1 else len(scores)), int(starts[-1])
        self._open(float(scores[0]), positive[:begin], weights[:begin])
        if len(starts) > 1:
            self._close()
            self._between(starts[1:-1] - begin, positive[begin:end], weights[begin:end])
            self._open(float(scores[-1]), positive[end:], weights[end:])

    def _open(self, score: float, positive: np.ndarray, weights: np.ndarray) -> None:
        """Rows of one score, that of the rows before or a new one."""
        if self.score is not None and score != self.score:
            self._close()
        if self.score is None:
            self.score, self.open = score, [np.zeros_like(self.pos), np.zeros_like(self.neg)]
        self.open[0] += weights[positive].sum(0)
        self.open[1] += weights[~positive].sum(0)

    def _close(self) -> None:
        pos, neg = self.open
        if self.first is None:
            self.first = (self.score, pos, neg)
        self.area += pos * (self.neg + neg / 2)
        self.neg, self.pos = self.neg + neg, self.pos + pos
        self.score = None

    def _between(self, starts: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> None:
        """Whole scores, neither the first nor the last of the range: neighbours of one class are added up together."""
        if not len(starts):
            return
        sizes = np.diff(np.append(starts, len(positive)))
        hits = np.add.reduceat(positive.astype(np.int64), starts)
        mixed = np.repeat((hits > 0) & (hits < sizes), sizes)
        level = np.repeat(np.arange(len(starts)), sizes)
        if mixed.any():  # the negatives of a score come first; half their pairs are taken off again
            order = np.lexsort((positive, level))
            positive, weights = positive[order], weights[order]
        begins = np.concatenate([[True], (positive[1:] != positive[:-1]) | ((level[1:] != level[:-1]) & (mixed[1:] | mixed[:-1]))])
        at = np.flatnonzero(begins)
        sums = np.add.reduceat(weights, at, axis=0, dtype=np.uint32)
        kind, halved = positive[at], mixed[at]
        pos, neg = sums[kind].astype(float), sums[~kind]
        run = np.zeros((len(neg) + 1, neg.shape[1]))
        np.cumsum(neg, axis=0, out=run[1:])
        run += self.neg
        before = np.cumsum(~kind)[kind]
        self.area += np.einsum("ij,ij->j", pos, run[before])
        if mixed.any():
            self.area -= (sums[kind & halved].astype(float) * sums[~kind & halved]).sum(0) / 2
        self.neg, self.pos = run[-1].copy(), self.pos + pos.sum(0)

    def finish(self) -> dict[str, object]:
        last = (self.score, *self.open)
        self._close()
        return {"pos": self.pos, "neg": self.neg, "area": self.area, "first": self.first, "last": last}


_RANGE = "part long, chunk int, pos array<double>, neg array<double>, area array<double>, first_score double, first_pos array<double>, first_neg array<double>, last_score double, last_pos array<double>, last_neg array<double>"


def auroc_draws(rows: DataFrame, by: Sequence[str], n_repeats: int) -> DataFrame:
    """``by, b, auroc`` of every repeat, from rows with ``score, positive, __unit``; null where a repeat has one class only."""
    by = list(by)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = rows.select(*by).schema.fields
    schema = StructType([*kinds, *StructType.fromDDL(_RANGE).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state: _Ranged | None = None
        current = None

        def pack(done: _Ranged) -> pa.RecordBatch:
            found = done.finish()
            cuts = range(0, n_repeats, CHUNK)
            chunks = len(cuts)

            def arrays(values: np.ndarray) -> pa.Array:
                return pa.array([values[at : at + CHUNK] for at in cuts], pa.list_(pa.float64()))

            columns = [done.row.column(k).take(pa.array([0] * chunks)) for k in range(len(by))]
            columns += [pa.array([part] * chunks, pa.int64()), pa.array(range(chunks), pa.int32())]
            columns += [arrays(found[k]) for k in ("pos", "neg", "area")]
            for side in ("first", "last"):
                score, pos, neg = found[side]
                columns += [pa.array([score] * chunks, pa.float64()), arrays(pos), arrays(neg)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(len(by) + 2)
            changes = pc.not_equal(code.slice(1), code.slice(0, len(code) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(code)]
            scores = batch.column(len(by)).to_numpy(zero_copy_only=False)
            positive = batch.column(len(by) + 1).to_numpy(zero_copy_only=False).astype(bool)
            of = _weights(batch.column(len(by) + 3), n_repeats)
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                name = code[begin].as_py()
                if name != current:
                    if state is not None:
                        yield pack(state)
                    state, current = _Ranged(batch.slice(begin, 1), n_repeats), name
                for at in range(begin, end, max(1, CELLS // n_repeats)):
                    to = min(end, at + max(1, CELLS // n_repeats))
                    state.feed(scores[at:to], positive[at:to], of(slice(at, to)))
        if state is not None:
            yield pack(state)

    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    ordered = rows.select(*by, "score", "positive", group.alias("__group"), "__unit")
    # Rows of one score may lie in any order, so weights that stand there as bytes are no key.
    keys = ["__group", "score", *(["__unit"] if isinstance(rows.schema["__unit"].dataType, StructType) else [F.xxhash64("__unit")])]
    ranges = ordered.repartitionByRange(width, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

    out = StructType([*kinds, *StructType.fromDDL("b int, auroc double").fields])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        chunk = table.column("chunk")[0].as_py()

        def of(column: str) -> np.ndarray:
            return np.stack([np.asarray(x) for x in table.column(column).to_pylist()])

        pos, neg = of("pos"), of("neg")
        before = np.cumsum(neg, axis=0) - neg
        area = (of("area") + pos * before).sum(0)
        sides = [(table.column(f"{s}_score").to_pylist(), of(f"{s}_pos"), of(f"{s}_neg")) for s in ("first", "last")]
        score, held = None, [0.0, 0.0]
        for k in range(table.num_rows):
            for side, (scores, p, n) in enumerate(sides):
                if side == 1 and scores[k] == sides[0][0][k]:
                    continue
                if scores[k] == score:  # earlier negatives of this score counted one, later ones nothing: each is half
                    area += (held[0] * n[k] - p[k] * held[1]) / 2
                    held = [held[0] + p[k], held[1] + n[k]]
                else:
                    score, held = scores[k], [p[k], n[k]]
        pairs = pos.sum(0) * neg.sum(0)
        value = np.divide(area, pairs, out=np.full(len(area), np.nan), where=pairs > 0)
        numbers = pa.array(np.arange(len(value)) + chunk * CHUNK, pa.int32())
        lead = [table.column(c).combine_chunks().take(pa.array([0] * len(value))) for c in by]
        lead = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in lead]
        return pa.table([*lead, numbers, pa.array(value, from_pandas=True)], names=out.names)

    return ranges.groupBy(*by, "chunk").applyInArrow(total, out)
