"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

SuperMinHash gives every element a random permutation of the signature's slots and, for rank j in
it, the value j + r with r uniform in [0, 1); a slot keeps the smallest value.  Values of rank j are
at least j, so an element stops as soon as every slot is below its next rank: large sets stop after
a rank or two.  As ranks are correlated, the signature's variance is below that of plain MinHash.

Equal sets are merged first.  The others meet in buckets of equal bands, where signatures are
compared inside the task and a spanning forest of the likely pairs leaves it; the components of these
forests are clusters, and no two documents of different clusters are likely to be linked.  Inside each
cluster all pairs whose sizes allow a link are then decided on full sets, and again only spanning forests of verified links leave a task.
A cluster is cut into blocks of bounded numbers of members and of shingles.  First every block is worked off by itself, with the cluster's
smallest member as a visitor.  Members that this joins to the cluster's largest group need not meet each other again; only the
others, the open ones, go on to all other blocks.  So a group of near copies passes each set on once, and no link is lost inside a
cluster.  A link between clusters is lost only if its signatures share no band or agree in less than ``likely`` of the
slots, more than five standard deviations below the threshold.  A bucket of more than ``bucket_rows`` members is worked off
block against block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bagstats.functions.spread import marked, marks_of
from bagstats.llm.components import components
from bagstats.llm.memo import handed_back, text_slices
from bagstats.llm.shingles import SLICE_BYTES, mix, set_digest, shingle_sets
from bagstats.sources.shared import written

SLOTS = 96
BAND_ROWS = 4
ELEMENTS = 50_000  # elements whose permutations are held at a time
BLOCK_SHINGLES = 1 << 20  # of a block of a cluster, on average
_EMPTY = np.uint64(2**64 - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.uint64(32)
_LOW = np.uint64(2**32 - 1)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (sets x slots, 32 bits each) of non-empty sets of 64-bit hashes."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full((len(sets), slots), _EMPTY)
    flat = best.reshape(-1)
    order = None  # permutation of each element that is still active, built as far as needed
    steps = np.arange(1, slots + 1, dtype=np.uint64) * _GOLDEN
    for rank in range(slots):
        if rank:
            active = (best.max(1) >= np.uint64(rank << 32))[owner]
            if not active.all():
                values, owner = values[active], owner[active]
                order = order[active] if order is not None else None
            if not len(values):
                break
        draw = mix(values + steps[rank])
        pick = rank + ((draw & _LOW) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(values), slots)).copy()
        rows = np.arange(len(values))
        slot = order[rows, pick]
        order[rows, pick] = order[:, rank]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(rank) << _RANK) | (draw >> np.uint64(32)))
    return (best & _LOW).astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, signature, low`` per row: ``node`` names the shingle set, ``low`` holds a byte per slot."""
    schema = "doc_id long, text_hash long, n_shingles long, node binary, signature binary, low binary"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            held: list[tuple[int, np.ndarray]] = []
            waiting = 0

            def close() -> None:
                nonlocal waiting
                if held:
                    signed = signatures([s for _, s in held])
                    low = signed.astype(np.uint8)
                    for (at, s), whole, part in zip(held, signed, low, strict=True):
                        rows[at] = (len(s), set_digest(s), whole.tobytes(), part.tobytes())
                held.clear()
                waiting = 0

            for hashes in shingle_sets(batch.column(1), shingle):
                rows.append((0, None, None, None))
                if len(hashes):
                    held.append((len(rows) - 1, hashes))
                    waiting += len(hashes)
                    if waiting >= ELEMENTS:
                        close()
            close()
            counts, nodes, signed, low = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), *[pa.array(x, pa.binary()) for x in (nodes, signed, low)]],
                names=["doc_id", "text_hash", "n_shingles", "node", "signature", "low"],
            )

    columns = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col), F.xxhash64(text_col).alias("text_hash")]
    return docs.select(*columns).mapInArrow(lambda batches: handed_back(sketch(batches)), schema)


def _forest(alike: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximum spanning forest over the positive entries of a symmetric matrix (Prim)."""
    count = len(alike)
    best, origin = np.zeros(count, alike.dtype), np.full(count, -1)
    waiting = np.ones(count, bool)
    for _ in range(count):
        k = int(np.argmax(np.where(waiting, best, -1)))
        if best[k] > 0:
            yield int(origin[k]), k
        waiting[k] = False
        closer = waiting & (alike[k] > best)
        best[closer], origin[closer] = alike[k][closer], k


def _alike(group: pa.RecordBatch, likely: float, min_ratio: float) -> np.ndarray:
    """Slots in which the signatures of two members agree, 0 where they cannot be linked or are compared elsewhere."""
    low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(-1, SLOTS)
    sizes = group.column("n_shingles").to_numpy()
    own = group.column("own").to_numpy()
    kin = group.column("kin").to_numpy() if "kin" in group.schema.names else np.zeros(len(own), np.int64)
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    alike = np.zeros((len(low), len(low)), np.int16)
    for k in range(len(low)):
        agree = (low == low[k]).sum(1)
        keep = (agree >= np.ceil(likely * SLOTS)) & (np.minimum(sizes, sizes[k]) >= min_ratio * np.maximum(sizes, sizes[k]))
        keep[k] = False
        if across:
            keep &= own != own[k]
        keep &= (kin != kin[k]) | (kin == 0)  # known to be of one group
        alike[k] = np.where(keep, np.maximum(agree, 1), 0)  # a pair that may be linked counts even without an equal slot
    return alike


def _linked(group: pa.RecordBatch, alike: np.ndarray, percent: int) -> np.ndarray:
    """``alike`` with 0 wherever the full sets are not alike enough, by counting shared shingles of all members at once."""
    sets = [np.frombuffer(s, np.uint64) for s in group.column("hashes").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    shared = np.zeros(alike.shape, np.int64)
    pairs = np.argwhere(np.triu(alike))
    if len(pairs) <= 2 * len(sets):
        for a, b in pairs:
            shared[a, b] = shared[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = count > 1
        column = (np.cumsum(common) - 1)[place]
        owner, column = owner[common[place]], column[common[place]]
        for begin in range(0, int(common.sum()), 4096):  # a product of 0 / 1 matrices counts exactly
            here = (column >= begin) & (column < begin + 4096)
            has = np.zeros((len(sets), 4096), np.float32)
            has[owner[here], column[here] - begin] = 1
            shared += (has @ has.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    return np.where(shared * 100 >= percent * union, alike, 0)


def _forests(batches: Iterator[pa.RecordBatch], alike: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Edges from the smallest member of every tree in the spanning forest of a run of equal (team, i, j) to the others, in sorted rows.

    Runs are small by construction.  Stars connect what the trees do, in fewer steps of :func:`components`, and are alike in many runs.
    """
    rest: pa.Table | None = None
    found: set[tuple[bytes, bytes]] = set()

    def search(run: pa.Table) -> None:
        rows = run.combine_chunks().to_batches()[0]
        nodes = rows.column("node").to_pylist()
        tree = list(range(len(nodes)))
        lowest = list(nodes)  # by tree
        for a, b in _forest(alike(rows)):  # ``a`` is in its tree before ``b``
            tree[b] = tree[a]
            lowest[tree[a]] = min(lowest[tree[a]], nodes[b])
        found.update((lowest[t], node) for t, node in zip(tree, nodes, strict=True) if lowest[t] != node)

    def pack() -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        code = pc.binary_join_element_wise(
            _as_text(table.column("team")), *[pc.cast(table.column(c), pa.string()) for c in ("i", "j")], ","
        ).combine_chunks()
        cuts = np.flatnonzero(pc.not_equal(code[1:], code[:-1]).to_numpy(zero_copy_only=False)) + 1
        for begin, end in zip([0, *cuts[:-1]], cuts, strict=False):
            if end - begin > 1:
                search(table.slice(begin, end - begin))
        rest = table.slice(cuts[-1] if len(cuts) else 0)
        if len(found) > 20_000:
            yield pack()
    if rest is not None and rest.num_rows > 1:
        search(rest)
    yield pack()


def _as_text(column: pa.ChunkedArray) -> pa.ChunkedArray:
    if pa.types.is_binary(column.type):
        return pa.chunked_array([pa.array([x.hex() for x in column.to_pylist()], pa.string())])
    return pc.cast(column, pa.string())


def _sorted_groups(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["team", "i", "j"]
    return rows.repartition(width, *keys).sortWithinPartitions(*keys)


def _own_blocks(members: DataFrame) -> DataFrame:
    """Members of every team in their own block, and its first member in all of them."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    seats = F.when(F.col("node") == F.col("first"), everywhere).otherwise(F.array(own))
    spread = members.withColumn("i", F.explode(seats)).drop("first", "blocks")
    spread = spread.withColumns({"j": F.col("i"), "own": F.lit(0), "kin": F.lit(0).cast("long")})
    return _sorted_groups(spread)


def _against_open(members: DataFrame, block_rows: int) -> DataFrame:
    """All members of the teams that have open ones, met with these in tiles: (block of the team, block of the open ones).

    A tile's own members have ``own`` 0, its visitors 1; an open member is among the own members of its block as well, and pairs
    of one group (``kin``) are known.  Only pairs of a member and a visitor are compared.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    visits = F.ceil(F.col("n_open") / block_rows).cast("int")
    seat = F.pmod(F.xxhash64("node", F.lit(1)), visits.cast("long")).cast("int")
    kept = [F.col(c) for c in members.columns if c not in ("blocks", "n_open", "is_open", "first")]
    own = members.select(*kept, F.lit(0).alias("own"), block.alias("i"), F.explode(F.sequence(F.lit(0), visits - 1)).alias("k"))
    visitors = members.filter("is_open").select(
        *kept, F.lit(1).alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("i"), seat.alias("k")
    )
    tiles = own.unionByName(visitors).withColumn("j", -1 - F.col("k")).drop("k")  # never i: a tile is always across
    return _sorted_groups(tiles)


def _forest_of_teams(
    rows: DataFrame,
    teams: DataFrame,
    block_rows: int,
    complete: Callable[[DataFrame, DataFrame | None], DataFrame],
    alike: Callable[[pa.RecordBatch], np.ndarray],
) -> DataFrame:
    """Edges ``a, b`` that connect what is alike inside every team: ``rows`` (``node, team``) of ``teams`` (``team, first, blocks``, written).

    ``complete`` adds what ``alike`` needs to members of all teams, or of those in its second argument.  Every block is
    worked off by itself, with the team's first member as a visitor; then, in teams that are not one group yet, what is outside the largest group meets all members of other groups.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return handed_back(_forests(batches, alike))

    edges = "a binary, b binary"
    found = written(_own_blocks(complete(rows.join(teams, "team"), None)).mapInArrow(search, edges), "edges")
    cut = teams.filter("blocks > 1")
    if cut.isEmpty():
        return found
    large = rows.join(cut, "team").join(components(found, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = large.groupBy("team", "component").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("team").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")
    )
    unfinished = written(main.filter("n > most").select("team", "main", (F.col("n") - F.col("most")).alias("n_open")), "open")
    if unfinished.isEmpty():
        return found
    parted = large.join(unfinished, "team").withColumn("is_open", F.col("component") != F.col("main"))
    parted = parted.withColumn("kin", F.xxhash64("component")).drop("component", "main")
    return found.unionByName(_against_open(complete(parted, unfinished), block_rows).mapInArrow(search, edges))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    likely: float = 0.58,
    bucket_rows: int = 2048,
    cluster_rows: int = 512,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Two rows are linked if ``100 * shared >= percent * union`` over their distinct ``shingle``-word
    sets (the whole word sequence for shorter texts).  ``component_id`` is the smallest id reachable
    by links, ``kept`` marks the row that bears it.  Texts that are null, empty or without words are
    linked with nothing.  Repeated rows share a component, and all rows with its smallest id are
    kept; null ids are never the smallest unless the component has no other.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = _grouped(docs, id_col, text_col, shingle, percent, likely, bucket_rows, cluster_rows)
    return rows.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash`` (``xxhash64`` of the text) of one row of each group, the smallest of both, and of one of its rows without id.

    Groups are those of the links: rows that share an id and have different texts are in one group only if linked.
    """
    rows = _grouped(docs, "doc_id", "text", shingle, percent).filter("n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    return rows.groupBy("component", F.col("doc_id").isNull().alias("nameless")).agg(first).select("first.*")


def _grouped(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int,
    percent: int,
    likely: float = 0.58,
    bucket_rows: int = 2048,
    cluster_rows: int = 512,
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component, component_id`` of every row; ``component`` is null without words."""
    sketched = written(sketches(docs, id_col, text_col, shingle), "sketches")
    # One node per distinct set; equal sets have equal signatures, so any row's will do.
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"), F.first("low").alias("low"),
    )
    nodes = written(nodes, "nodes")
    bands = F.explode(F.sequence(F.lit(0), F.lit(SLOTS // BAND_ROWS - 1))).alias("band")
    band = F.expr(f"substring(signature, band * {4 * BAND_ROWS} + 1, {4 * BAND_ROWS})")
    buckets = nodes.select("node", "signature", bands).select("node", F.xxhash64("band", band).alias("team"))
    shared = buckets.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    shared = written(shared.select("team", "first", F.ceil(F.col("n") / bucket_rows).alias("blocks")), "buckets")
    sizes = nodes.select("node", "n_shingles", "low")
    ratio = percent / 100
    proposed = _forest_of_teams(buckets, shared, bucket_rows, lambda rows, _: rows.join(sizes, "node"), lambda rows: _alike(rows, likely, ratio))

    clusters = components(proposed, "a", "b").withColumnRenamed("component", "team")
    clusters = written(clusters.join(nodes.select("node", "row", "n_shingles", "low"), "node"), "clusters")
    members = clusters.count()

    def with_sets(rows: DataFrame, only: DataFrame | None) -> DataFrame:
        wanted = clusters if only is None else clusters.join(only, "team", "left_semi")
        return _sets(docs, rows, marks_of(wanted, F.xxhash64("row.doc_id", "row.text_hash"), members), members, id_col, text_col, shingle)

    sums = clusters.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / cluster_rows), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks")
    # A cluster bears the name of its smallest member.
    teams = written(sums.select("team", F.col("team").alias("first"), blocks), "teams")
    links = _forest_of_teams(
        clusters.drop("n_shingles"), teams, cluster_rows, with_sets, lambda rows: _linked(rows, _alike(rows, 0.0, ratio), percent),
    )
    linked = components(links, "a", "b")

    labels = nodes.select("node", "first_id").join(linked, "node", "left")
    labels = labels.withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = labels.join(smallest, "component").select("node", "component", "component_id")
    rows = sketched.select("doc_id", "text_hash", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", "component", component.alias("component_id"))


def _sets(docs: DataFrame, needed: DataFrame, marks: DataFrame, most: int, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The wanted nodes with their full sets, each from one of its rows, found by id and text hash.

    The bits of the wanted rows (``marks``, for ``most`` rows) stop nearly all other texts where they are read; the join decides.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    texts = marked(texts, F.xxhash64("doc_id", "text_hash"), marks, most)
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_hash") == F.col("row.text_hash"))
    carried = [c for c in needed.columns if c != "row"]
    # Repeated rows are one again; two texts of one id and hash stay two, and the digest tells them apart.
    rows = texts.join(needed, same).select("text", *carried).dropDuplicates(["node", "text"])
    kinds = rows.select(*carried).schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in text_slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                names = part.column(1 + carried.index("node"))
                kept, sets = [], []
                for k, hashes in enumerate(shingle_sets(texts, shingle)):
                    if len(hashes) and set_digest(hashes) == names[k].as_py():
                        kept.append(k)
                        sets.append(hashes.tobytes())
                chosen = part.take(pa.array(kept, pa.int64()))
                sizes = pa.array([len(x) // 8 for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*chosen.columns[1:], sizes, pa.array(sets, pa.binary())], names=[*carried, "n_shingles", "hashes"])

    schema = StructType([*kinds.fields, *StructType.fromDDL("n_shingles long, hashes binary").fields])
    return rows.mapInArrow(lambda batches: handed_back(build(batches)), schema)
