"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced exactly.

Why the splice is exact.  The tokenizer cuts a text into pre-tokens by a scan from left to
right that looks ahead at most a few characters and never back, and it merges only inside a
pre-token.  So if a position is a pre-token boundary both in the true encoding and in the
encoding of a chunk, everything after it is the same in both, up to the chunk's right edge.
A chunk that starts anywhere is therefore right from the first boundary it shares with the
chunk before it, and such a shared boundary, kept ``margin`` characters away from the right
edge of the earlier chunk, is where the two are joined.  Where the overlap holds no shared
boundary the overlap and the chunk are doubled until one is found, at the latest when the
chunk starts at the last proven boundary.

Short texts need no chunks.  They are cut before a space that follows a character other than
white space, which is always a pre-token boundary by the same argument, and each distinct
piece is encoded once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.llm.memo import Memo, load_tokenizer

CUT = re.compile(r"(?<=\S)(?= )")
UNCUTTABLE = r"[\s\x0b\x1c-\x1f\x85\p{Z}] "  # white space before a space: no boundary there
_workers: dict = {}


def _boundaries(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pre-token boundaries of a text (characters) and the number of tokens before each; the last pair is the end."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    words = encoded.word_ids
    count = len(words)
    if not count:
        return np.array([0, len(text)]), np.array([0, 0])
    starts = np.fromiter((a for a, _ in encoded.offsets), np.int64, count)
    marks = np.array([-1 if w is None else w for w in words], np.int64)
    # A special token has no piece number of its own in some versions; it always stands alone.
    fresh = np.concatenate([[True], (marks[1:] != marks[:-1]) | (marks[1:] < 0) | (marks[:-1] < 0)])
    places = np.flatnonzero(fresh)
    return np.append(starts[places], len(text)), np.append(places, count)


def spliced_count(tokenizer, text: str, chunk: int, overlap: int, margin: int) -> tuple[int, int]:
    """Number of tokens of a text encoded in overlapping chunks, and how often an overlap had to be widened."""
    total = widened = 0
    proven, begin = 0, 0  # tokens before ``proven`` are counted; the current chunk starts at ``begin``
    end = min(len(text), chunk)
    places, before = _boundaries(tokenizer, text[:end])
    while end < len(text):
        width, size = overlap, chunk
        while True:
            start = max(proven, end - width)
            stop = min(len(text), start + max(size, 2 * width))
            next_places, next_before = _boundaries(tokenizer, text[start:stop])
            shared = np.intersect1d(places + begin, next_places + start)
            shared = shared[(shared >= proven) & (shared <= end - margin) & (shared < stop)]
            if len(shared) and stop > end:
                break
            width, size, widened = 2 * width, 2 * size, widened + 1
            if start == proven and not len(shared):  # a proven boundary is shared by definition
                shared = np.array([proven])
                if stop > end:
                    break
        joint = int(shared[-1])
        total += _at(places + begin, before, joint) - _at(places + begin, before, proven)
        places, before, begin, end, proven = next_places, next_before, start, stop, joint
    return total + int(before[-1]) - _at(places + begin, before, proven), widened


def _at(places: np.ndarray, before: np.ndarray, place: int) -> int:
    return int(before[np.searchsorted(places, place)])


def piece_counts(memo: Memo, texts: pa.Array) -> np.ndarray:
    """Token counts of texts by their distinct pieces; texts hold no null."""
    counts = np.zeros(len(texts), np.int64)
    plain = pc.invert(pc.match_substring_regex(texts, UNCUTTABLE)).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~plain)
    where = np.flatnonzero(plain)
    if len(where):
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten()
        offsets = offsets - offsets[0]
        leading = np.zeros(len(pieces), bool)
        leading[offsets[:-1]] = True  # split gives at least one piece per text
        first = memo.tokenizer.encode_batch_fast(pieces.filter(pa.array(leading)).to_pylist(), add_special_tokens=False)
        later = pieces.filter(pa.array(~leading)).dictionary_encode()
        sizes, _, _ = memo(pc.binary_join_element_wise(pa.scalar(""), later.dictionary, " "))
        values = np.zeros(len(pieces), np.int64)
        values[leading] = [len(e) for e in first]
        values[~leading] = sizes[later.indices.to_numpy()]
        counts[where] = np.add.reduceat(values, offsets[:-1])
    for k in rest:
        cut = pa.array(CUT.split(texts[int(k)].as_py())).dictionary_encode()
        sizes, _, _ = memo(cut.dictionary)
        counts[k] = sizes[cut.indices.to_numpy()].sum()
    return counts


def _worker(path: str, memo_strings: int) -> tuple[Memo, int]:
    """Tokenizer and memo of this Python worker, kept between its tasks; and the margin."""
    if (path, memo_strings) not in _workers:
        tokenizer = load_tokenizer(path)
        longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
        _workers[path, memo_strings] = Memo(tokenizer, memo_strings, keep_ids=False), longest + 8
    return _workers[path, memo_strings]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap_chars: int = 512,
    memo_strings: int = 400_000,
) -> DataFrame:
    """``id, n_bytes, n_tokens, n_widened`` of every text.

    ``n_tokens`` is what the tokenizers library gives for the whole text with its default handling
    of special strings, without added tokens, truncation or padding.  Texts of more than
    ``chunk_chars`` characters are encoded in chunks overlapping by ``overlap_chars``;
    ``n_widened`` counts overlaps that had to be widened.  A null or empty text has 0 bytes and 0
    tokens; repeated rows and null ids stay rows of their own; other columns are ignored.  Nothing
    is shuffled: a text is handled where it is read.
    """
    if overlap_chars < 1 or chunk_chars <= 2 * overlap_chars:
        raise ValueError("chunk_chars must be more than twice overlap_chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, margin = _worker(tokenizer_path, memo_strings)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            if pa.types.is_large_string(texts.type):
                texts = texts.cast(pa.string())
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            counts = np.zeros(len(texts), np.int64)
            widened = np.zeros(len(texts), np.int64)
            huge = lengths > chunk_chars
            for k in np.flatnonzero(huge):
                counts[k], widened[k] = spliced_count(
                    memo.tokenizer, texts[int(k)].as_py(), chunk_chars, overlap_chars, margin
                )
            counts[~huge] = piece_counts(memo, texts.filter(pa.array(~huge)))
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts), pa.array(widened)], names=[id_col, "n_bytes", "n_tokens", "n_widened"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, n_widened long")
