"""Exact resamples, n draws of n units for each repeat, without moving a draw.

Draws are many (n times repeats) and follow from a hash, rows are few.  So rows are packed into blocks, every task gets all
blocks and makes all draws of its own repeats: a count per unit in one byte, which the rows then look up.

* Blocks of cells hold the units of rows of one (label, prediction); a repeat's confusion counts are sums of their units' counts.
* Blocks of scores hold units in the order of (score, outcome); a repeat's area is a running sum over them.  A score may go
  on over many blocks, so that no score is a task of its own: what it holds is added up until the next one begins.

A task writes the blocks to a file of its own and maps it, so its memory is a byte per unit and some pieces of the blocks.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bagstats.sources.shared import written

BLOCK = 1 << 16  # rows of a block at most
HELD = 1 << 18  # rows that a task collects before it packs them
LOW = 5  # digits in which the unit numbers of a piece differ
PIECE = 20_000  # numbers hashed at a time, so that they stay in a core's cache
CHUNK = 8192  # result rows at a time

# The rotations and constants of MD5, and the word that each step takes.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_LEFT, _RIGHT = [np.array(t, np.uint32) for t in _TURNS], [np.array(32 - t, np.uint32) for t in _TURNS]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STEPS = 61  # what follows does not touch the first word


def _first_word(words: Sequence[int], parts: dict[int, np.ndarray], held: Sequence[np.ndarray]) -> np.ndarray:
    """First word of the MD5 of messages of one block: ``words`` are alike in all of them but for ``parts``, which are added.

    ``held`` are five arrays to work in; the result is one of them.  Few and plain calls: their number is what this costs.
    """
    xor, both, either, add, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
    a, b, c, d, t = held
    for x, v in zip(held, _START, strict=False):
        x.fill(v)
    constants = list(np.array([(words[_WORDS[i]] + _SINES[i]) & 0xFFFFFFFF for i in range(_STEPS)], np.uint32).reshape(-1, 1))
    for i in range(_STEPS):
        if i < 16:
            xor(c, d, t), both(t, b, t), xor(t, d, t)
        elif i < 32:
            xor(b, c, t), both(t, d, t), xor(t, c, t)
        elif i < 48:
            xor(b, c, t), xor(t, d, t)
        else:
            np.invert(d, t), either(t, b, t), xor(t, c, t)
        add(a, t, a), add(a, constants[i], a)
        if _WORDS[i] in parts:
            add(a, parts[_WORDS[i]], a)
        left(a, _LEFT[i], t), right(a, _RIGHT[i], a), either(a, t, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return add(b, np.uint32(_START[0]), b)


def _bytes(numbers: np.ndarray, digits: int) -> Iterator[np.ndarray]:
    """The last digits of numbers as characters, from left to right."""
    return (numbers // np.uint32(10 ** (digits - 1 - k)) % np.uint32(10) + np.uint32(48) for k in range(digits))


def _digits() -> list[list[np.ndarray]]:
    """By the place of its first byte in a word: what the last digits of a number add to this word and to the next."""
    numbers = np.arange(10**LOW, dtype=np.uint32)
    out = []
    for place in range(4):
        pair = [np.zeros(len(numbers), np.uint32) for _ in range(2)]
        for k, byte in enumerate(_bytes(numbers, LOW), place):
            pair[k // 4] += byte << np.uint32(k % 4 * 8)
        out.append(pair)
    return out


_DIGITS = _digits()


def drawn_numbers(seed: int, repeat: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces ``first, numbers`` of the 32-bit numbers behind ``uniform(seed, repeat, unit_no)`` for ``unit_no`` of 1 to ``n``."""
    whole = 10**LOW
    room = [np.empty(min(PIECE, n), np.uint32) for _ in range(5)]

    def piece(head: str, low: int, high: int, digits: int) -> np.ndarray:
        """Of the messages ``head`` with the last ``digits`` digits of ``low`` to ``high``."""
        start, size = len(head.encode()), len(head.encode()) + digits
        if size > 55:
            raise ValueError(f"{head} and a unit number are longer than one block")
        words = np.frombuffer(head.encode().ljust(size, b"\0") + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), "<u4").tolist()
        parts: dict[int, np.ndarray] = {}
        if digits == LOW:
            parts = {start // 4 + k: part[low:high] for k, part in enumerate(_DIGITS[start % 4])}
        else:
            for k, byte in enumerate(_bytes(np.arange(low, high, dtype=np.uint32), digits), start):
                parts[k // 4] = parts.get(k // 4, np.uint32(0)) + (byte << np.uint32(k % 4 * 8))
        return _first_word(words, parts, [x[: high - low] for x in room]).byteswap()

    for digits in range(1, LOW):
        for low in range(10 ** (digits - 1), min(10**digits, n + 1), PIECE):
            yield low, piece(f"{seed}:{repeat}:", low, min(low + PIECE, 10**digits, n + 1), digits)
    for first in range(0, n + 1, whole):
        for low in range(0 if first else whole // 10, min(whole, n + 1 - first), PIECE):
            yield first + low, piece(f"{seed}:{repeat}:{first // whole or ''}", low, min(low + PIECE, whole, n + 1 - first), LOW)


def draw_counts(seed: int, repeat: int, sizes: Sequence[int]) -> list[np.ndarray]:
    """How often each unit comes up in ``size`` draws, for groups of these sizes, which share their hashes."""
    counts = [np.zeros(size, np.uint8) for size in sizes]
    for first, numbers in drawn_numbers(seed, repeat, max(sizes)):
        for size, count in zip(sizes, counts, strict=True):
            if size >= first:
                # As Spark does it: the number over 2^32 is exact, its product with the size is rounded once.
                np.add.at(count, (numbers[: size + 1 - first] * (size / 2.0**32)).astype(np.intp), np.uint8(1))
    for k, size in enumerate(sizes):
        if int(counts[k].sum(dtype=np.int64)) != size:  # a unit came up more than 255 times
            wide = np.zeros(size, np.int64)
            for first, numbers in drawn_numbers(seed, repeat, size):
                wide += np.bincount((numbers * (size / 2.0**32)).astype(np.intp), minlength=size)
            counts[k] = wide
    return counts


# --- blocks -----------------------------------------------------------------

_BLOCK = "__cell string, part long, seq int, n_units long, units binary, ends binary, kinds binary, tied binary, first double, last double"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_FOUND = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.float64()]


def _block(row: pa.Table, lead: Sequence[str], seq: int, units: np.ndarray, *more: object) -> pa.RecordBatch:
    """One block, named by the columns ``lead`` and ``__cell`` of a row."""
    size = row.column("n_units")[0].as_py()
    if size >= 1 << 32:
        raise ValueError(f"Exact draws of {size} units: unit numbers have 32 bits")
    names = [*lead, "__cell"]
    found = [TaskContext.get().partitionId(), seq, size, (units - 1).astype("<u4").tobytes(), *(more or [None] * 5)]
    columns = [pa.concat_arrays(row.column(c).chunks) for c in names]
    columns += [pa.array([v], kind) for v, kind in zip(found, _FOUND, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[*lead, *_NAMES])


def _cell_blocks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of units of one cell, from ``by, label, pred, unit_no, n_units``."""
    lead = [*by, "label", "pred"]
    schema = StructType([*rows.select(*lead).schema.fields, *StructType.fromDDL(_BLOCK).fields])
    cell = F.to_json(F.struct(F.lit(0).alias("of"), *lead), {"ignoreNullFields": "false"}).alias("__cell")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = seq = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            name = pc.dictionary_encode(table.column("__cell")).combine_chunks()
            name = (name if isinstance(name, pa.DictionaryArray) else pa.concat_arrays(name.chunks)).indices.to_numpy()
            unit = table.column("unit_no").to_numpy()
            order = np.lexsort((unit, name))
            starts = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]])).tolist()
            for begin, end in zip(starts, [*starts[1:], len(order)], strict=True):
                for at in range(begin, end, BLOCK):
                    own = order[at : min(at + BLOCK, end)]
                    seq += 1
                    yield _block(table.slice(int(own[0]), 1), lead, seq, unit[own])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= HELD:
                yield from blocks()
                count = 0
        if held:
            yield from blocks()

    return rows.select(*lead, cell, "unit_no", "n_units").mapInArrow(pack, schema)


def _score_blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of units in the order of (score, outcome), from ``keys, score, positive, unit_no, n_units``.

    A block tells its runs: where each ends, its outcome, whether it is of the block's first or last score, and which stand
    beside the other outcome of one score.  Neighbours of one outcome are one run, but for the first and last score, which may
    go on in other blocks.
    """
    keys = list(keys)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(_BLOCK).fields])
    cell = F.to_json(F.struct(F.lit(1).alias("of"), *keys), {"ignoreNullFields": "false"}).alias("__cell")
    order = ["__cell", "score", "positive", "unit_no"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, seq, current = 0, 0, None

        def block() -> pa.RecordBatch:
            nonlocal seq, count
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            count = 0
            seq += 1
            score = table.column("score").to_numpy()
            positive = table.column("positive").to_numpy().astype(bool)
            new = np.concatenate([[True], score[1:] != score[:-1]])
            level = np.cumsum(new) - 1
            hits = np.bincount(level, positive)
            tied = (hits > 0) & (hits < np.bincount(level))
            alone = tied.copy()
            alone[[0, -1]] = True
            parted = new[1:] & (alone[level[1:]] | alone[level[:-1]])
            begins = np.flatnonzero(np.concatenate([[True], (positive[1:] != positive[:-1]) | parted]))
            at_first, at_last = level[begins] == 0, level[begins] == level[-1]
            pairs = np.flatnonzero(tied[level[begins]] & ~at_first & ~at_last & ~positive[begins])  # a score's misses come before its hits
            kinds = (positive[begins] + 2 * at_first + 4 * at_last).astype(np.uint8)
            ends = np.append(begins[1:], len(score)).astype("<u4")
            units = table.column("unit_no").to_numpy()
            return _block(table.slice(0, 1), keys, seq, units, ends.tobytes(), kinds.tobytes(), pairs.astype("<u4").tobytes(), float(score[0]), float(score[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(len(keys))
            changes = pc.not_equal(code.slice(1), code.slice(0, len(code) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(code)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                name = code[begin].as_py()
                for at in range(begin, end, BLOCK):
                    size = min(BLOCK, end - at)
                    if held and (name != current or count + size > BLOCK):
                        yield block()
                    current = name
                    held.append(batch.slice(at, size))
                    count += size
        if held:
            yield block()

    ordered = rows.select(*keys, cell, "score", "positive", "unit_no", "n_units").repartitionByRange(width, *order)
    return ordered.sortWithinPartitions(*order).mapInArrow(pack, schema)


# --- repeats ----------------------------------------------------------------


class _Cells:
    """The cells of one group: pieces of units one after the other, where cells end in them and which cells these are."""

    def __init__(self) -> None:
        self.names: list[int] = []
        self.held: list[tuple[int, list[int], list[int]]] = []
        self.pieces: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, begin: int, size: int) -> None:
        """More units of the cell named last."""
        if not self.held or begin + size - self.held[-1][0] > 2 * BLOCK:
            self.held.append((begin, [], []))
        first, ends, codes = self.held[-1]
        if codes and codes[-1] == len(self.names) - 1:
            ends.pop()
        else:
            codes.append(len(self.names) - 1)
        ends.append(begin + size - first)

    def sums(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.pieces:
            self.pieces = [(first, np.array(ends), np.array(codes)) for first, ends, codes in self.held]
        out = np.zeros(len(self.names), np.int64)
        for begin, ends, codes in self.pieces:
            run = np.cumsum(counts[units[begin : begin + ends[-1]]], dtype=np.int64)[ends - 1]
            out[codes] += np.diff(run, prepend=0)
        return out


class _Scores:
    """The blocks of one group in the order of their scores."""

    def __init__(self, name: int) -> None:
        self.name = name
        self.blocks: list[tuple] = []

    def add(self, begin: int, size: int, ends: bytes, kinds: bytes, tied: bytes, first: float, last: float) -> None:
        ends, kind, tied = np.frombuffer(ends, "<u4"), np.frombuffer(kinds, np.uint8), np.frombuffer(tied, "<u4")
        edges = [(value, np.flatnonzero(kind & bit)) for value, bit in ((first, 2), (last, 4))]
        self.blocks.append((begin, begin + size, ends - 1, (kind & 1).astype(bool), tied, edges[:1] if first == last else edges))

    def area(self, units: np.ndarray, counts: np.ndarray) -> float | None:
        area, hits, misses = 0.0, 0, 0
        score, held = None, (0, 0)  # of the score that may go on
        for begin, end, ends, positive, tied, edges in self.blocks:
            run = np.diff(np.cumsum(counts[units[begin:end]], dtype=np.int64)[ends], prepend=0).astype(float)
            pos = np.where(positive, run, 0.0)
            neg = run - pos
            area += float(pos @ (np.cumsum(neg) + misses))  # a run of hits adds no misses
            if len(tied):  # misses of the same score counted whole
                area -= float(neg[tied] @ pos[tied + 1]) / 2
            for value, own in edges:
                if value != score:
                    area -= held[0] * held[1] / 2
                    score, held = value, (0, 0)
                held = (held[0] + int(pos[own].sum()), held[1] + int(neg[own].sum()))
            hits, misses = hits + int(pos.sum()), misses + int(neg.sum())
        area -= held[0] * held[1] / 2
        return area / (hits * misses) if hits and misses else None


def exact_repeats(
    cells: DataFrame | None, scored: DataFrame | None, by: Sequence[str], keys: Sequence[str], seed: int, n_repeats: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """``by, b, label, pred, n`` and ``keys, b, auroc`` of every repeat, written once: the draws are made once for both.

    They come from rows ``by, label, pred, unit_no, n_units`` and ``keys, score, positive, unit_no, n_units``, of which either may
    be missing; ``keys`` begin with ``by``.  The area is null where a repeat has one class only.
    """
    by, keys = list(by), list(keys)
    made = ([] if cells is None else [_cell_blocks(cells, by)]) + ([] if scored is None else [_score_blocks(scored, keys)])
    blocks = made[0].unionByName(made[1], allowMissingColumns=True) if len(made) == 2 else made[0]
    lead = [c for c in blocks.columns if c not in _NAMES]
    context = blocks.sparkSession.sparkContext
    width = max(1, min(n_repeats, 2 * context.defaultParallelism))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    tasks = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    dealt = blocks.select(*lead, *_NAMES, group.alias("__group"), tasks.alias("__task")).repartitionById(width, "__task")
    dealt = dealt.sortWithinPartitions("__group", "__cell", "part", "seq")
    out = StructType([*blocks.select(*lead, "__cell").schema.fields, *StructType.fromDDL("b int, n long, auroc double").fields])

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[pa.RecordBatch] = []
        groups: dict[str, tuple[int, _Cells, list[_Scores]]] = {}
        task, at, current = 0, 0, None
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                for k in range(batch.num_rows):
                    name = columns["__cell"][k].as_py()
                    size, own, scores = groups.setdefault(columns["__group"][k].as_py(), (columns["n_units"][k].as_py(), _Cells(), []))
                    found = [columns[c][k].as_py() for c in ("ends", "kinds", "tied", "first", "last")]
                    if name != current:
                        current, task = name, columns["__task"][k].as_py()
                        names.append(batch.select([*lead, "__cell"]).take(pa.array([k])))
                        if found[0] is None:
                            own.names.append(len(names) - 1)
                        else:
                            scores.append(_Scores(len(names) - 1))
                    data = columns["units"][k].as_buffer()
                    file.write(data)
                    if found[0] is None:
                        own.add(at, data.size // 4)
                    else:
                        scores[-1].add(at, data.size // 4, *found)
                    at += data.size // 4
            if not at:
                return
            file.flush()
            units = np.memmap(file, "<u4", "r", shape=(at,))
            named = pa.Table.from_batches(names).combine_chunks()
            found = []

            def pack() -> pa.RecordBatch:
                name, b, n, auroc = zip(*found, strict=True)
                found.clear()
                held = named.take(pa.array(name)).combine_chunks()
                columns = [pa.concat_arrays(c.chunks) for c in held.columns]
                return pa.RecordBatch.from_arrays([*columns, pa.array(b, pa.int32()), pa.array(n, pa.int64()), pa.array(auroc, pa.float64())], names=out.names)

            for b in range(task * n_repeats // width, (task + 1) * n_repeats // width):
                counts = draw_counts(seed, b, [size for size, _, _ in groups.values()])
                for (_, own, scores), count in zip(groups.values(), counts, strict=True):
                    found += [(name, b, n, None) for name, n in zip(own.names, own.sums(units, count).tolist(), strict=True) if n]
                    found += [(s.name, b, None, s.area(units, count)) for s in scores]
                    if len(found) >= CHUNK:
                        yield pack()
            if found:
                yield pack()

    results = written(dealt.mapInArrow(repeat, out), "repeats")
    counted = results.filter(F.col("__cell").startswith('{"of":0')).select(*by, "b", "label", "pred", "n") if cells is not None else None
    areas = results.filter(F.col("__cell").startswith('{"of":1')).select(*keys, "b", "auroc") if scored is not None else None
    return counted, areas
