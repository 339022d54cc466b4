"""Word shingles of whole texts as 64-bit hashes (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from bagstats.llm.memo import text_slices

SLICE_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text and the place of each text's first word (one more place at the end).

    Words are runs without ASCII white space, A-Z in lower case; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    coded = words.filter(filled).dictionary_encode()
    distinct = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary)
    )
    return distinct[coded.indices.to_numpy()], before[offsets]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than ``size`` words the whole sequence is one."""
    for part in text_slices(texts, SLICE_BYTES):
        yield from _shingle_sets(part, size)


def _shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    hashes, places = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled * _STEP + hashes[k : k + len(rolled)] + np.uint64(k + 1))
    for begin, end in zip(places[:-1], places[1:], strict=True):
        if end - begin >= size:
            yield np.unique(rolled[begin : end - size + 1])
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for k, h in enumerate(hashes[begin:end]):
                whole = mix(whole * _STEP + h + np.uint64(k + 1 + size * int(end - begin)))
            yield whole
        else:
            yield np.empty(0, np.uint64)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    sums = [mix(hashes).sum(dtype=np.uint64), mix(hashes ^ _STEP).sum(dtype=np.uint64)]
    return np.array(sums, np.uint64).tobytes()
