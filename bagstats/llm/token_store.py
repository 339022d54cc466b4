"""Token-id store: blocks of concatenated ids with Elias-Fano document boundaries, in document order.

A store is a folder of Parquet files whose rows are blocks: ``part, block, n_docs, n_ids,
ids_before`` (ids of earlier blocks of the part) and ``payload``, the binary block of
``elias_fano.write_block``.  Parts are ranges of document ids, so a document's global offset is
the ids of earlier parts + ``ids_before`` + its boundary: no table of 64-bit offsets exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagstats.llm.elias_fano import TokenBlock, write_block
from bagstats.llm.memo import Memo, concat_ranges, load_tokenizer

EXPAND_IDS = 1 << 20  # ids expanded at a time
READ_DOCS, READ_IDS = 1024, 1 << 20  # documents, and ids, read back at a time
_workers: dict = {}


def _worker(path: str, memo_strings: int) -> Memo:
    if (path, memo_strings) not in _workers:
        _workers[path, memo_strings] = Memo(load_tokenizer(path), memo_strings, keep_ids=True)
    return _workers[path, memo_strings]


def encode_words(memo: Memo, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts: (first text, ids per text, ids).

    For tokenizers that drop white space: the ids of a text are then those of its words, one after
    the other, and each distinct word of a batch is encoded once.  Texts hold no null.
    """
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    # Leading and trailing white space gives empty strings, which encode to nothing.
    words = lists.flatten().dictionary_encode()
    del lists
    codes = words.indices.to_numpy()
    sizes, first, pool = memo(words.dictionary)
    before = np.concatenate([[0], np.cumsum(sizes[codes])])[offsets]  # ids before each text
    begin, count = 0, len(texts)
    while begin < count:
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + EXPAND_IDS, "right")) - 1)
        run = codes[offsets[begin] : offsets[end]]
        yield begin, np.diff(before[begin : end + 1]), pool[concat_ranges(first[run], sizes[run])]
        begin = end


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 1 << 20,
    memo_strings: int = 400_000,
) -> None:
    """Encode whole texts, end each with ``end_id`` and write the store in ascending id order.

    The tokenizer must be one of the tokenizers library that drops white space.  A null text is
    empty (only its end id); null ids come first; rows of equal id follow each other by a hash of
    the text; repeated rows stay.  A document is never cut: a block closes after the document that
    reaches ``block_ids``.  Other columns are ignored; an empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    width = 2 if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _worker(tokenizer_path, memo_strings)
        part = TaskContext.get().partitionId()
        number = passed = waiting = 0
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number, passed, waiting
            doc_ids = pa.concat_arrays(keys)
            block_sizes, block = np.concatenate(sizes), np.concatenate(ids)
            payload = write_block(doc_ids.drop_null().to_numpy(), doc_ids.null_count, block_sizes, block, width)
            row = [part, number, len(block_sizes), len(block), passed, payload]
            number, passed, waiting = number + 1, passed + len(block), 0
            for held in (keys, sizes, ids):
                held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for begin, counts, run in encode_words(memo, texts):
                ended = np.insert(run, np.cumsum(counts), end_id)
                keys.append(batch.column(0).slice(begin, len(counts)))
                sizes.append(counts + 1)
                ids.append(ended)
                waiting += len(ended)
                if waiting >= block_ids:
                    yield close()
        if keys:
            yield close()

    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
         ("ids_before", pa.int64()), ("payload", pa.binary())]
    )
    made = ranged.mapInArrow(blocks, "part int, block int, n_docs long, n_ids long, ids_before long, payload binary")
    made.write.option("compression", "zstd").parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every stored document; ``ids`` are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it.  Boundaries come by select, for ``READ_DOCS`` documents at a
    time, so no table of a block's offsets is made.  Only the totals of the parts, one row per
    part written, are broadcast.
    """
    blocks = spark.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("ids_before")).alias("base"), "payload")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = TokenBlock(payload.as_buffer())
                begin = 0
                while begin < block.documents:
                    end = min(begin + READ_DOCS, block.documents)
                    bounds = block.bounds_of(begin, end)
                    fitting = int(np.searchsorted(bounds - bounds[0], READ_IDS, "right")) - 1
                    end = begin + max(1, min(end - begin, fitting))
                    bounds = bounds[: end - begin + 1]
                    doc_ids = pa.concat_arrays(
                        [pa.nulls(max(0, min(end, block.without_id) - begin), pa.int64()), pa.array(block.ids_of(begin, end), pa.int64())]
                    )
                    data = pa.py_buffer(block.all_ids[bounds[0] : bounds[-1]].astype("<u4"))
                    if bounds[-1] - bounds[0] >= 1 << 29:
                        raise ValueError("one document is too long to read back as one value")
                    places = pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), end - begin, [None, places, data])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), ids],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    begin = end

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
