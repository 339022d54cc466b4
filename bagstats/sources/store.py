"""The patch store: sorted Parquet patches, a small index, rejects, and shard plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagstats.functions.keys import hash_bucket, hash_key
from bagstats.functions.spread import beside, even_buckets, running_sums, tasks_for
from bagstats.operators.bags import cap_by_name
from bagstats.operators.quality import judge_bags, source_fingerprint, split_judged, validate_bag_index
from bagstats.sources.shared import written

# Fixed value: size limit of one export shard.
SHARD_LIMIT_BYTES = 9_500_000_000
_BYTES_PER_VALUE = 4
_ROW_BYTES = 64  # of a patch without its features, in a sort
TASK_BYTES = 32_000_000  # of stored patches that a task sorts
BLOCK_BAGS = 16_384  # most bags of a packing block, on average
_PER_BLOCK = 2**32  # numbers of bags in blocks are told apart by this
LISTED = 1000  # slides that may stand in a filter one by one


def _shard_of(n_shards: int) -> Column:
    number = F.conv(F.substring(hash_key("shard", "slide_id"), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(n_shards)).cast("int")


def bag_index(
    patches: DataFrame, raw: DataFrame | None = None, n_shards: int = 64, raw_counts: DataFrame | None = None
) -> DataFrame:
    """One row per slide: stored and raw patches, dimension, size, and its row range in a shard.

    Raw patches are counted in ``raw``, or known already (``raw_counts``: ``slide_id, raw_patches``).
    Shards are hash shards, so ``n_shards`` bounds the slides one window sees;
    raise it with the number of slides.
    """
    stored = patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_patches"), F.max(F.size("features")).alias("feat_dim")
    )
    if raw is None and raw_counts is None:
        sized = stored.withColumn("raw_patches", F.col("n_patches"))
    else:
        counts = raw_counts if raw is None else raw.groupBy("slide_id").agg(F.count(F.lit(1)).alias("raw_patches"))
        sized = stored.join(counts, "slide_id", "left").withColumn("raw_patches", F.coalesce("raw_patches", F.lit(0)))
    rows = sized.withColumn("shard", _shard_of(n_shards))
    before = Window.partitionBy("shard").orderBy("slide_id").rowsBetween(Window.unboundedPreceding, -1)
    bytes_per_row = F.col("feat_dim") * _BYTES_PER_VALUE + 2 * _BYTES_PER_VALUE
    return rows.select(
        "slide_id",
        "n_patches",
        "raw_patches",
        "feat_dim",
        F.lit(2).alias("coord_dim"),
        "shard",
        F.coalesce(F.sum("n_patches").over(before), F.lit(0)).alias("start_row"),
        (F.col("n_patches") * bytes_per_row).alias("est_bytes"),
    )


def pack_by_size(index: DataFrame, limit_bytes: int = SHARD_LIMIT_BYTES, exact: bool = False) -> DataFrame:
    """Whole bags to export shards of limited size, in hash order: ``slide_id, est_bytes, pack``.

    The default cuts a distributed running sum at multiples of the limit; a bag that lies
    across a cut gets a shard of its own, so no shard of several bags passes the limit and
    at most every other shard holds a single bag.  ``exact`` is the sequential rule: a new shard opens whenever the next bag would
    not fit in the open one (an oversized bag has its own), one result for any partitioning.
    """
    if exact:
        return _next_fit(index, limit_bytes)
    keyed = index.select("slide_id", "est_bytes").withColumn("__key", hash_key("pack", "slide_id"))
    order, levels = [F.col("__key"), F.col("slide_id")], [hash_bucket(F.col("__key"))]
    sized = running_sums(keyed, [], order, levels, {"size": F.col("est_bytes")})
    first = F.floor(F.col("size_before") / F.lit(limit_bytes))
    across = F.col("size_before") + F.col("est_bytes") > (first + 1) * F.lit(limit_bytes)
    return sized.select("slide_id", "est_bytes", (first * 2 + across.cast("bigint")).alias("pack"))


def _followers(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for every bag of a block, the first bag that does not fit in a shard opened at it (the block's length: none)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return starts, ends, np.maximum(np.searchsorted(ends, starts + limit, side="right"), np.arange(1, len(sizes) + 1))


def _sizes_of(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _block(limit: int) -> Callable[[pa.Table], pa.Table]:
    """One row per block: its bags in order, and those whose shard is still open at its end (``pos``) with the place ``at`` up to which that shard reaches."""

    def made(bags: pa.Table) -> pa.Table:
        bags = bags.sort_by([("__key", "ascending"), ("slide_id", "ascending")])
        held = {c: bags[c].combine_chunks() for c in ("slide_id", "est_bytes")}
        starts, ends, follower = _followers(_sizes_of(held["est_bytes"]), limit)
        n = len(ends)
        pos = np.flatnonzero(follower == n)
        # A bag beyond the limit ends its shard, whatever comes next.
        at = np.where(ends[pos] - starts[pos] > limit, -1, starts[pos] + limit)
        row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table({
            "block": bags["block"].slice(0, 1), "n": [n], "bytes": [int(ends[-1])], "slides": row(held["slide_id"]),
            "sizes": row(held["est_bytes"]), "pos": row(pa.array(pos, pa.int64())), "at": row(pa.array(at, pa.int64())),
        })

    return made


def _links(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From every open shard (``src``) that asks where the next one opens: that bag (``entry``), the shards opened from it on in this
    block, and the last of these (``next``)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ends, follower = _followers(_sizes_of(batch["sizes"][i].values), limit)
                last, count, steps = list(range(len(ends))), [1] * len(ends), follower.tolist()
                for k in range(len(ends) - 1, -1, -1):
                    if steps[k] < len(ends):
                        last[k], count[k] = last[steps[k]], count[steps[k]] + 1
                b, asked = batch["b"][i].as_py(), batch["ats"][i].values.to_numpy()
                entry = np.searchsorted(ends, np.where(asked < 0, -1, asked - batch["start"][i].as_py()), side="right")
                yield pa.record_batch({
                    "src": batch["srcs"][i].values, "next": pa.array(b * _PER_BLOCK + np.array(last)[entry], pa.int64()),
                    "b": pa.array(np.full(len(entry), b), pa.int64()), "entry": pa.array(entry, pa.int64()), "opened": pa.array(np.array(count)[entry], pa.int64()),
                })

    return linked


def _packed(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bags of every block with their shard: ``base`` shards were opened before, the first here at ``entry``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                slides, sizes, at = batch["slides"][i].values, batch["sizes"][i].values, batch["entry"][i].as_py()
                opens = np.zeros(len(sizes), np.int64)
                steps = _followers(_sizes_of(sizes), limit)[2].tolist()
                while at is not None and at < len(steps):
                    opens[at] = 1
                    at = steps[at]
                pack = np.cumsum(opens) + (batch["base"][i].as_py() - 1)
                yield pa.record_batch({"slide_id": slides, "est_bytes": sizes, "pack": pa.array(pack, pa.int64())})

    return packed


def _next_fit(index: DataFrame, limit: int) -> DataFrame:
    """Sequential next-fit without a sequence.

    Bags are dealt in hash order to blocks of bounded numbers of bags.  Inside a block a running sum tells for every bag which one opens the
    next shard.  Between blocks only the bags whose shard is open at the end of their block count: each asks the block where that shard
    ends, which answers with the last shard opened there.  The shards that are really open are those reached from the first bag: each round
    adds what the reached ones lead to and doubles the reach of the links.  So the rounds move a few rows per block, not all bags.
    """
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("slide_id", "est_bytes")}
    held = written(index.select("slide_id", "est_bytes"), "index")
    n_bags = held.count()
    digits = 1
    while n_bags > BLOCK_BAGS * 16**digits:
        digits += 1
    key = hash_key("pack", "slide_id")
    dealt = held.withColumn("block", hash_bucket(key, digits)).repartition(tasks_for(held, n_bags), "block").withColumn("__key", key)
    schema = f"block string, n bigint, bytes bigint, slides array<{kinds['slide_id']}>, sizes array<{kinds['est_bytes']}>, pos array<bigint>, at array<bigint>"
    blocks = written(dealt.groupBy("block").applyInArrow(_block(limit), schema), "blocks")

    coarse = F.substring("block", 1, max(1, digits - 2))
    sums = {"start": F.col("bytes"), "b": F.lit(1).cast("bigint")}
    numbers = running_sums(blocks.select("block", "bytes"), [], [F.col("block")], [coarse], sums)
    numbers = written(numbers.select("block", F.col("b_before").alias("b"), F.col("start_before").alias("start"), (F.col("start_before") + F.col("bytes")).alias("end")), "numbers")

    waiting = blocks.select("block", F.inline(F.arrays_zip("pos", "at"))).join(numbers, "block")
    waiting = waiting.select((F.col("b") * _PER_BLOCK + F.col("pos")).alias("src"), "b", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") + F.col("start")).alias("at"))
    no_source, none = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    marks = waiting.filter("at >= 0").select("at", none.alias("ends"), "src").unionByName(numbers.select(F.col("end").alias("at"), F.lit(1).cast("bigint").alias("ends"), no_source.alias("src")))
    # A block's end at the very limit still fits: ends come first among equal marks.
    counted = running_sums(even_buckets(marks, "at", "bucket"), [], [F.col("at"), F.col("ends").desc()], [F.col("bucket")], {"fit": F.col("ends")})
    asks = counted.filter("ends = 0").select("src", F.col("fit_before").alias("b"), "at")
    asks = asks.unionByName(waiting.filter("at < 0").select("src", (F.col("b") + 1).alias("b"), "at"))
    first = numbers.filter("b = 0").select(F.lit(-1).cast("bigint").alias("src"), "b", F.lit(-1).cast("bigint").alias("at"))
    asks = asks.unionByName(first).groupBy("b").agg(F.collect_list(F.struct("src", "at")).alias("asks"))
    asked = numbers.join(asks, "b").select("block", "b", "start", F.col("asks.src").alias("srcs"), F.col("asks.at").alias("ats"))
    links = blocks.select("block", "sizes").join(asked, "block").mapInArrow(_links(limit), "src bigint, next bigint, b bigint, entry bigint, opened bigint")
    links = written(links, "links")

    reached, jumps = first.select("src"), links.select("src", "next")
    while True:
        fresh = reached.join(jumps, "src").select(F.col("next").alias("src")).join(reached, "src", "left_anti").distinct()
        fresh = written(fresh, "reached")
        if fresh.isEmpty():
            break
        reached = written(reached.unionByName(fresh), "reached")
        beyond = jumps.select(F.col("src").alias("next"), F.col("next").alias("beyond"))
        jumps = written(jumps.join(beyond, "next").select("src", F.col("beyond").alias("next")), "jumps")
    entries = links.join(reached, "src", "left_semi").select("b", "entry", "opened")
    based = numbers.join(entries, "b", "left").select("block", "entry", F.coalesce("opened", F.lit(0)).alias("opened"))
    based = running_sums(based, [], [F.col("block")], [coarse], {"base": F.col("opened")}).select("block", "entry", F.col("base_before").alias("base"))
    placed = blocks.select("block", "slides", "sizes").join(based, "block")
    return placed.mapInArrow(_packed(limit), f"slide_id {kinds['slide_id']}, est_bytes {kinds['est_bytes']}, pack bigint")


def read_patches(
    spark: SparkSession,
    path: str,
    slides: DataFrame | Sequence | None = None,
    window: tuple[int, int] | None = None,
    indices: DataFrame | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Stored patches of some slides, an index range, or listed (slide, patch) rows.

    A short slide list and a range become Parquet filters; the store is sorted by them.  A longer list or a table of slides or rows
    is held beside the patches (see ``beside``), so the wide rows are not moved for it.
    """
    df = spark.read.parquet(path)
    if slides is not None and not isinstance(slides, DataFrame) and len(slides) > LISTED:
        kind = df.schema["slide_id"].dataType.simpleString()
        slides = spark.createDataFrame([(s,) for s in slides], f"slide_id {kind}")
    if isinstance(slides, DataFrame):
        df = beside(df, slides.select("slide_id").distinct(), ["slide_id"], "left_semi")
    elif slides is not None:
        df = df.filter(F.col("slide_id").isin(list(slides)))
    if window is not None:
        start, stop = window
        df = df.filter((F.col("patch_idx") >= start) & (F.col("patch_idx") < stop))
    if indices is not None:
        df = beside(df, indices.select("slide_id", "patch_idx").distinct(), ["slide_id", "patch_idx"], "left_semi")
    return df.select(*columns) if columns is not None else df


def write_patch_store(
    patches: DataFrame,
    path: str,
    cap: int | None = None,
    strategy: str = "spatial_sqrt",
    max_records_per_file: int = 1_000_000,
    n_shards: int = 64,
    **cap_options,
) -> DataFrame:
    """Validate, cap, sort and publish patches; the index comes last and marks the store complete.

    The scan facts (one row per slide) are written first, so validation runs once and raw patches are known.
    Range partitioning uses the patch index too, so a huge slide is cut over
    several files.  Returns the violations found when the store is read back.
    """
    spark = patches.sparkSession
    judge_bags(patches, rows=patches.count()).write.mode("errorifexists").parquet(f"{path}/scan")
    valid, rejects = split_judged(spark.read.parquet(f"{path}/scan"))
    rejects.write.mode("errorifexists").json(f"{path}/rejects")
    accepted = beside(patches, valid.select("slide_id"), ["slide_id"], "left_semi")
    stored = cap_by_name(accepted, cap, strategy, **cap_options) if cap else accepted
    # Partitions that a task sorts in memory, whatever the length of the feature vectors.
    kept = F.least(F.col("n_patches"), F.lit(cap)) if cap else F.col("n_patches")
    size = valid.agg(F.sum(kept * (F.col("feat_dim") * 2 * _BYTES_PER_VALUE + _ROW_BYTES)).alias("size")).first()["size"] or 0
    (
        stored.repartitionByRange(1 + size // TASK_BYTES, "slide_id", "patch_idx")
        .sortWithinPartitions("slide_id", "patch_idx")
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(f"{path}/patches")
    )
    back = spark.read.parquet(f"{path}/patches")
    index = bag_index(back, None, n_shards, valid.select("slide_id", F.col("n_patches").alias("raw_patches")))
    index.write.mode("errorifexists").parquet(f"{path}/index")
    stored_index = spark.read.parquet(f"{path}/index")
    settings = {"cap": cap, "strategy": strategy, "n_shards": n_shards, **cap_options}
    source_fingerprint(stored_index, settings).write.mode("errorifexists").json(f"{path}/identity")
    return validate_bag_index(stored_index, back, n_shards)
