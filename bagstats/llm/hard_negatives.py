"""Hard negatives by a secondary-sort shuffle of packed pair scores.

Anchors and rows meet in blocks of bounded size, where all their integer inner products are taken.  A block passes on
only what can be in the result: for each anchor its best ``positives`` rows of the same label, and, once the
anchor's positives are known, for each of them the first ``negatives`` rows of other labels in its window of scores.
Every pair that is passed on is one key of 25 bytes, (anchor, descending score, kind, id), whose order as bytes is that of the
fields.  ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts them on the way; a
streaming iterator reads them once: a positive opens a window of scores, a negative goes to all open windows it falls in, and
a window closes when it is full or left behind.  It holds one anchor's open windows and never an anchor's rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.llm.vectors import is_finite, matrix, of_one_length
from bagstats.sources.shared import written

ROW_BLOCK, ANCHOR_BLOCK = 8192, 2048
AT_ONCE = 256  # anchors whose scores are held at a time
POSITIVE, NEGATIVE = 0, 1
_SIGN = 1 << 63
_MASK = (1 << 64) - 1
_FIELDS = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])


def pack(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is anchor, falling score, kind (positives first), id."""
    keys = np.empty(len(anchors), _FIELDS)
    keys["anchor"] = anchors.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    keys["score"] = ~(scores.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    keys["kind"] = kind
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    size = _FIELDS.itemsize
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, ident = (int.from_bytes(key[a:b], "big") for a, b in ((0, 8), (8, 16), (17, 25)))
    return anchor - _SIGN, (~score & _MASK) - _SIGN, key[16], ident - _SIGN


def anchor_slot(key: bytes) -> int:
    """Decides the partition of a key: all keys of an anchor meet."""
    return zlib.crc32(key[:8])


def windows(keys: Iterator[tuple[bytes, None]], negatives: int, low: int, high: int) -> Iterator[tuple[int, ...]]:
    """``(anchor, positive, rank, negative, positive score, negative score)`` of sorted keys; holds the open windows of one anchor."""
    current = None
    opened: list[list[int]] = []  # positive, its score, bounds, negatives taken
    for key, _ in keys:
        anchor, score, kind, ident = unpack(key)
        if anchor != current:
            current, opened = anchor, []
        if kind == POSITIVE:
            opened.append([ident, score, low * score, high * score, 0])
            continue
        opened = [w for w in opened if w[4] < negatives and 100 * score >= w[2]]
        for window in opened:
            if 100 * score <= window[3]:
                window[4] += 1
                yield anchor, window[0], window[4], ident, window[1], score


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest allowed entries of every row, ties to the lower column."""
    lowest = np.iinfo(scores.dtype).min if scores.dtype.kind == "i" else -np.inf
    masked = np.where(allowed, scores, scores.dtype.type(lowest))
    width = masked.shape[1]
    if width > k:
        cut = np.partition(masked, width - k, axis=1)[:, width - k]
        allowed = allowed & (masked >= cut[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def _single(block: pa.Table, mark: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in rising order, labels, vectors and places in the block: of one id the row with the smallest label and vector."""
    ids, labels = block.column(f"{mark}id").to_numpy(), block.column(f"{mark}label").to_numpy()
    values = matrix(block.column(f"{mark}x"), dim)
    order = np.lexsort((*values.T[::-1], labels, ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    order = order[np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))] if len(ids) else order
    return ids[order], labels[order], values[order], order


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "x",
    anchor_col: str = "is_anchor",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and each of its positives.

    Vectors hold integers (or whole numbers as doubles); a score is the integer inner product with the anchor.  An anchor's
    positives are the best ``positives`` other rows of its label, and a positive's negatives the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * score <= high * positive_score``; higher scores come first, ties by smaller id.  A
    positive below 0 has no such rows, as its window is empty.  Rows with a null id or label, a null or empty
    vector, a null or non-finite component or another length than most take no part; of one id only the
    row with the smallest label and vector counts; a null mark is no anchor.  Other columns are ignored; an empty table
    gives an empty result.  Fails if a score could pass 64 bits.
    """
    spark = vectors.sparkSession
    marked = F.coalesce(F.col(anchor_col), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("x"), marked.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("x")))
    rows, dim = of_one_length(rows, "x")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("top")
    ).first()
    if not size.asking:
        return spark.createDataFrame([], shape)
    top = int(size.top)
    bound = dim * top * top
    if bound * max(100, abs(low), abs(high)) >= 1 << 63:
        raise ValueError(f"{dim} components of up to {top} give scores beyond 64 bits")
    kind = "smallint" if top < 1 << 15 else "int" if top < 1 << 31 else "bigint"
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # holds every partial sum exactly
    rows = rows.select("id", "label", F.col("x").cast(f"array<{kind}>").alias("x"), "asks")
    row_blocks, anchor_blocks = -(-size.n // ROW_BLOCK), -(-size.asking // ANCHOR_BLOCK)

    def dealt(table: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own)
        return table.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    found_in = dealt(rows.select("id", "label", "x"), "i", row_blocks, "j", anchor_blocks)

    def met(anchors: DataFrame, choose) -> DataFrame:
        """Keys that ``choose(scores, same label, other id, rows of the anchors' block)`` selects in every pair of blocks."""
        asked = dealt(anchors, "j", anchor_blocks, "i", row_blocks)
        asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in asked.columns])

        def search(found: pa.Table, asked: pa.Table) -> pa.Table:
            parts = []
            if found.num_rows and asked.num_rows:
                ids, labels, values, _ = _single(found, "", dim)
                own, own_labels, own_values, places = _single(asked, "asked_", dim)
                turned = np.ascontiguousarray(values.astype(exact).T)
                for at in range(0, len(own), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    scores = own_values[part].astype(exact) @ turned
                    same = own_labels[part, None] == labels[None, :]
                    foreign = own[part, None] != ids[None, :]
                    for kind, row, column in choose(scores, same, foreign, asked.take(pa.array(places[part]))):
                        parts.append(pack(own[part][row], scores[row, column], kind, ids[column]))
            return pa.table([pa.chunked_array(parts, pa.binary())], ["key"])

        keys = ["i", "j"]
        return found_in.groupBy(*keys).cogroup(asked.groupBy(*[f"asked_{k}" for k in keys])).applyInArrow(search, "key binary")

    def nearest_alike(scores, same, foreign, _):
        yield POSITIVE, *_best(scores, same & foreign, positives)

    def in_windows(scores, same, foreign, block):
        other = ~same & foreign
        whole = scores.astype(np.int64) * 100
        wanted = block.column("asked_scores").to_pylist()
        pairs = []
        for k in range(max(map(len, wanted))):
            score = np.array([w[k] if k < len(w) else -1 for w in wanted], np.int64)[:, None]
            pairs.append(np.stack(_best(scores, other & (whole >= low * score) & (whole <= high * score), negatives), 1))
        yield NEGATIVE, *np.unique(np.concatenate(pairs), axis=0).T

    def sorted_keys(keys: DataFrame):
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(width, anchor_slot)

    def leading(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        current, count = None, 0
        for key, _ in keys:
            count = count + 1 if key[:8] == current else 1
            current = key[:8]
            if count <= positives:
                anchor, score, _, _ = unpack(key)
                yield bytearray(key), anchor, score

    anchors = rows.filter("asks").select("id", "label", "x")
    first = sorted_keys(met(anchors, nearest_alike)).mapPartitions(leading)
    first = written(spark.createDataFrame(first, "key binary, id long, score long"), "positives")
    levels = first.filter("score >= 0").groupBy("id").agg(F.collect_set("score").alias("scores"))  # ``positives`` at most
    candidates = met(anchors.join(levels, "id"), in_windows)
    streamed = sorted_keys(first.select("key").unionByName(candidates)).mapPartitions(lambda keys: windows(keys, negatives, low, high))
    return spark.createDataFrame(streamed, shape, verifySchema=False)
