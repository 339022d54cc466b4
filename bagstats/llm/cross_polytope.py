"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table turns vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and files each under the signed axis nearest to it.  A query looks under its ``probes`` nearest
signed axes in each table.  Vectors and queries of one axis meet in one group, where all inner
products are taken and only the best ``k`` of each query leave, so the rows passed on grow with
the queries alone.  An axis with very many vectors or queries is cut into blocks of bounded size, all of
which are searched: nothing is dropped.

Vectors need not have length one.  Among vectors of similar length the largest inner products are the smallest
angles, so the best ``k`` of all are, in every band of lengths, among the nearest by angle, which is what the
tables find.  That holds as long as ``k`` are few of the band: bands of fewer than ``SPARSE * k`` different
vectors, a single long one for instance, are searched whole by every query.  So is the whole table by the queries
that found fewer than ``k`` in the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.sources.shared import written

VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
BAND, SPARSE = 1.05, 25  # ratio of the lengths in a band; vectors for each neighbour asked for from which tables find enough
WHOLE = -1  # stands for all axes


def rotation_signs(tables: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths; the width is a power of two."""
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(count, width)
        step *= 2
    return rows / np.sqrt(width)


def axes(rows: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of every row, nearest first; axis ``a`` stands for ``a + width`` if negative."""
    for s in signs:
        rows = hadamard(rows * s)
    ways = np.concatenate([rows, -rows], 1)
    return np.argsort(-ways, axis=1, kind="stable")[:, :probes]


def _best(queries: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` largest inner products of each query, its own id left out, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = np.ascontiguousarray(vectors[order].T), ids[order]
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    for at in range(0, len(queries), 256):
        part, own = queries[at : at + 256], query_ids[at : at + 256]
        scores = np.zeros((len(part), len(ids)))
        for axis in range(vectors.shape[0]):  # in one fixed order, so equal vectors get equal scores everywhere
            scores += part[:, axis, None] * vectors[axis]
        if len(starts) < len(ids):  # of one id only the best vector counts
            scores = np.maximum.reduceat(scores, starts, axis=1)
        scores[own[:, None] == ids[None, starts]] = -np.inf
        first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, first, 1)
        rows, places = np.nonzero(found > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[rows]), pa.array(ids[starts[first[rows, places]]]), pa.array(found[rows, places])],
            names=["query_id", "vec_id", "score"],
        )


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = 10,
    probes: int = 12,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` marks its ``k`` best among all other rows.

    ``score`` is the inner product of the original vectors in double precision, summed in order of the
    components.  Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do null ids.  Rows of equal id and vector count once; a query is never its
    own neighbour, whatever row bears its id; equal scores go to the smaller id; fewer candidates than ``k`` are all
    returned.  ``probes`` is for up to 64 components and grows in proportion to the width above.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    rows = rows.withColumn("length", F.sqrt(squares)).filter("length > 0")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    dim, longest = (most.dim, most.longest) if most else (1, 1.0)
    rows = rows.filter(F.size("v") == dim).withColumn("band", F.floor(F.log(F.lit(longest) / F.col("length")) / F.log(F.lit(BAND))).cast("int"))
    bands = rows.groupBy("band").agg(F.count_distinct(F.xxhash64("v")).alias("n"))
    sparse = [r.band for r in bands.filter(F.col("n") < SPARSE * k).collect()]  # under 4,000 bands, whatever the floats
    width = 1 << (dim - 1).bit_length()
    signs = rotation_signs(tables, width, seed)
    per_table = min(max(probes, -(-probes * width // 64)), 2 * width)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            plain = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(count, dim)
            padded = np.zeros((count, width))
            padded[:, :dim] = plain
            asks = np.where(batch.column(2).to_numpy(zero_copy_only=False).astype(object) == True, True, False)  # noqa: E712  null is no
            whole = np.isin(batch.column(3).to_numpy(zero_copy_only=False), sparse)
            looks = np.full((asks.sum(), tables * per_table + 1), WHOLE)
            if asks.any():
                looks[:, 1:] = np.concatenate([axes(padded[asks], s, per_table) + t * 2 * width for t, s in enumerate(signs)], 1)
            homes = np.stack([axes(padded, s, 1)[:, 0] for s in signs], 1) + np.arange(tables) * 2 * width
            data = pa.array([r.tobytes() for r in plain], pa.binary())

            def lists(held: np.ndarray, values: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], held.cumsum()]), pa.int32()), pa.array(values, pa.int32()))

            probe = lists(np.where(asks, tables * per_table + 1, 0), looks.ravel())
            kept = np.ones_like(homes, bool)
            kept[whole, 1:] = False
            homes[whole, 0] = WHOLE
            home = lists(kept.sum(1), homes[kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), data, home, probe], names=["vec_id", "data", "homes", "looks"])

    filed = rows.select("vec_id", "v", "asks", "band").mapInArrow(file, "vec_id long, data binary, homes array<int>, looks array<int>")
    filed = written(filed.distinct(), "filed")

    first = written(_met(filed, dim, k), "found")
    # A query must end with k rows, or with all other ids where there are fewer.
    needed = min(k, filed.select("vec_id").distinct().count() - 1)
    served = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= needed)
    short = filed.filter(F.size("looks") > 0).join(served, F.col("vec_id") == F.col("query_id"), "left_anti")
    if needed < 1 or short.isEmpty():
        return first
    everything, nothing = F.array(F.lit(WHOLE)), F.array().cast("array<int>")
    again = filed.select("vec_id", "data", everything.alias("homes"), nothing.alias("looks"))
    again = again.unionByName(short.select("vec_id", "data", nothing.alias("homes"), everything.alias("looks")))
    return first.join(served, "query_id", "left_semi").unionByName(_met(again, dim, k))


def _met(filed: DataFrame, dim: int, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of every query among the vectors at home on an axis it looks at."""

    # Sizes of the axes: tables * 2 * width rows at most, whatever the input.
    def blocks(name: str, size: int) -> DataFrame:
        counts = filed.select(F.explode(name).alias("axis")).groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
        return F.broadcast(counts.select("axis", F.ceil(F.col("n") / size).cast("int").alias(f"{name}_blocks")))

    of_vectors, of_queries = blocks("homes", VECTOR_BLOCK), blocks("looks", QUERY_BLOCK)

    def dealt(name: str, own: str, other: str) -> DataFrame:
        """Rows per axis they belong to, in their own block and once for every block of the other side."""
        spread = filed.select("vec_id", "data", F.explode(name).alias("axis")).join(of_vectors, "axis").join(of_queries, "axis")
        mine = F.pmod(F.xxhash64("vec_id"), F.col(f"{name}_blocks").cast("long")).cast("int")
        return spread.select("axis", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias("b"), "vec_id", "data")

    found_in = dealt("homes", "i", "looks").withColumnRenamed("b", "j")
    asked_in = dealt("looks", "j", "homes").withColumnRenamed("b", "i")
    asked_in = asked_in.select(*[F.col(c).alias(f"asked_{c}") for c in ("axis", "i", "j", "vec_id", "data")])
    keys = ["axis", "i", "j"]

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        parts: list[pa.RecordBatch] = []
        if found.num_rows and asked.num_rows:
            parts = list(
                _best(
                    _matrix(asked.column("asked_data"), dim).astype(np.float64), _matrix(found.column("data"), dim).astype(np.float64),
                    asked.column("asked_vec_id").to_numpy(), found.column("vec_id").to_numpy(), k,
                )
            )
        return pa.Table.from_batches(parts, schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    pairs = found_in.groupBy(*keys).cogroup(asked_in.groupBy(*[f"asked_{c}" for c in keys])).applyInArrow(search, "query_id long, vec_id long, score double")
    single = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return single.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
