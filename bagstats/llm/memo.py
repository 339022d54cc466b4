"""Encode repeated strings once: a bounded memo around the tokenizers library, used inside tasks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task

SLICE = 20_000


def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Memo:
    """Ids of strings.  Keeps about ``limit`` strings, or twice those of one call: when full, the half that most calls
    asked for stays, the newer ones first.  The limit changes time and memory but never a result."""

    def __init__(self, tokenizer, limit: int, keep_ids: bool):
        self.tokenizer, self.limit, self.keep_ids = tokenizer, limit, keep_ids
        self.known = pa.array([], pa.string())
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.uses = np.empty(0, np.int32)  # calls that asked for a string

    def _shrink(self, room: int) -> None:
        if len(self.known) <= room:
            return
        order = np.lexsort((-np.arange(len(self.uses)), -self.uses))
        kept = np.sort(order[: max(0, room)])
        if self.keep_ids:
            first = np.cumsum(self.sizes) - self.sizes
            self.ids = self.ids[concat_ranges(first[kept], self.sizes[kept])]
        self.known, self.sizes, self.uses = self.known.take(pa.array(kept)), self.sizes[kept], self.uses[kept]

    def _encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], []
        for at in range(0, len(strings), SLICE):
            found = self.tokenizer.encode_batch_fast(strings.slice(at, SLICE).to_pylist(), add_special_tokens=False)
            if self.keep_ids:
                lists = [e.ids for e in found]
                sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
            else:
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        empty = np.empty(0, np.int64)
        return np.concatenate(sizes or [empty]), np.concatenate(ids or [np.empty(0, np.uint32)])

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct strings: number of ids, place of the first in the id pool, and the pool (empty without ``keep_ids``)."""
        at = pc.index_in(strings, value_set=self.known)
        missing = strings.filter(at.is_null())
        if len(missing):
            if len(self.known) + len(missing) > self.limit:
                here = at.drop_null().to_numpy()
                self.uses[here] += 1 << 20  # what this call asks for stays
                self._shrink(max(self.limit // 2, len(here)))
                self.uses[self.uses >= 1 << 20] -= 1 << 20
            sizes, ids = self._encode(missing)
            self.known = pa.concat_arrays([self.known, missing])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(missing), np.int32)])
            at = pc.index_in(strings, value_set=self.known)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[at] += 1
        first = np.cumsum(self.sizes) - self.sizes
        return self.sizes[at], first[at], self.ids


def text_slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive runs of texts of at most ``limit`` bytes, or of one longer text: bounds the memory of a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Return freed memory to the machine.  Spark keeps Python workers between tasks, and what an idle one holds counts as the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def handed_back(made: Iterator) -> Iterator:
    """What a task makes, unchanged; the memory is given back after the last."""
    try:
        yield from made
    finally:
        give_back()


def concat_ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``first[i] ... first[i] + sizes[i] - 1`` of all ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(first - starts, sizes)
