"""Elias-Fano sequences and the token block built on them (numpy, used inside tasks).

A non-decreasing sequence of ``n`` values below ``u`` takes about ``2 + log2(u / n)`` bits per
value: the low bits are stored plainly, the high parts as set bits of a bit vector (value ``i`` is
bit ``high + i``).  Every ``SAMPLE``-th set bit's place is stored, so ``select(i)`` reads one
sample and counts bits in a few words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQQ")  # values, low bits, bytes of low part, of high part, of samples
_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)


class EliasFano:
    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count = len(values)
        if count and (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        top = int(values[-1]) if count else 0
        low_bits = max(0, ((top + 1) // max(count, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        vector = np.zeros(int(places[-1]) + 1 if count else 0, np.uint8)
        vector[places] = 1
        return cls(count, low_bits, low, np.packbits(vector, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.count, self.low_bits, self.low.nbytes, self.high.nbytes, self.samples.nbytes)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at a place, and the place after it."""
        count, low_bits, *sizes = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.uint32), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(count, low_bits, *parts), at

    def select(self, i: int) -> int:
        """Value ``i`` from the nearest sample, without reading the whole sequence."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        missing = i % SAMPLE
        byte = place // 8
        missing += int(_BITS[self.high[byte] & ((1 << place % 8) - 1)])  # set bits of this byte before the sample
        while (found := int(_BITS[self.high[byte]])) <= missing:
            missing -= found
            byte += 1
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[missing]
        high = byte * 8 + int(inside) - i
        first = i * self.low_bits
        window = self.low[first // 8 : (first + self.low_bits + 7) // 8]
        low = int.from_bytes(window.tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def select_many(self, wanted: np.ndarray) -> np.ndarray:
        """Values of many places: of the bit vector only the runs between the samples around them are read."""
        wanted = np.asarray(wanted, np.int64)
        if not len(wanted):
            return np.empty(0, np.int64)
        if wanted.min() < 0 or wanted.max() >= self.count:
            raise IndexError((int(wanted.min()), int(wanted.max())))
        runs = wanted // SAMPLE
        places = np.empty(len(wanted), np.int64)
        order = np.argsort(runs, kind="stable")
        cuts = np.flatnonzero(np.diff(runs[order], prepend=-1))
        for begin, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[begin:end]
            run = int(runs[rows[0]])
            first = int(self.samples[run])
            last = int(self.samples[run + 1]) // 8 + 1 if run + 1 < len(self.samples) else len(self.high)
            bits = np.flatnonzero(np.unpackbits(self.high[first // 8 : last], bitorder="little")) + first // 8 * 8
            places[rows] = bits[np.searchsorted(bits, first) + wanted[rows] - run * SAMPLE]
        high = places - wanted
        if not self.low_bits:
            return high
        if self.low_bits > 56:  # with the shift inside a byte more than a word: one by one
            return np.array([self.select(int(i)) for i in wanted], np.int64)
        start = wanted * self.low_bits
        padded = np.concatenate([self.low, np.zeros(8, np.uint8)])
        word = sum(padded[start // 8 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8))
        low = (word >> (start % 8).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return high << self.low_bits | low.astype(np.int64)

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (places - np.arange(self.count)).astype(np.uint64)
        bits = np.unpackbits(self.low, count=self.count * self.low_bits, bitorder="little")
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (bits.reshape(self.count, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        return (high << np.uint64(self.low_bits)) | low


_BLOCK = struct.Struct("<4sBQQqQ")  # magic, bytes per id, documents, of them without id, smallest id, token ids
MAGIC = b"EFT1"


def write_block(doc_ids: np.ndarray, without_id: int, sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """Documents in ascending order, the first ``without_id`` of them with a null id: ``doc_ids`` holds the rest."""
    base = int(doc_ids[0]) if len(doc_ids) else 0
    keys = EliasFano.of(doc_ids.astype(np.uint64) - np.uint64(base % 2**64))
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
    head = _BLOCK.pack(MAGIC, width, len(sizes), without_id, base, len(ids))
    return head + keys.to_bytes() + ends.to_bytes() + ids.astype("<u2" if width == 2 else "<u4").tobytes()


class TokenBlock:
    """A block read back; ``data`` is not copied."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.documents, self.without_id, self.base, self.length = _BLOCK.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.keys, at = EliasFano.from_bytes(view, _BLOCK.size)
        self.bounds, at = EliasFano.from_bytes(view, at)
        self.all_ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", self.length, at)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.without_id else self.base + self.keys.select(k - self.without_id)

    def ids(self, k: int) -> np.ndarray:
        """Token ids of document ``k`` of the block."""
        return self.all_ids[self.bounds.select(k) : self.bounds.select(k + 1)]

    def doc_ids(self) -> np.ndarray:
        return (self.keys.values() + np.uint64(self.base % 2**64)).astype(np.int64)

    def bounds_of(self, first: int, last: int) -> np.ndarray:
        """Starts of documents ``first`` to ``last - 1`` of the block and the end of the last one."""
        return self.bounds.select_many(np.arange(first, last + 1))

    def ids_of(self, first: int, last: int) -> np.ndarray:
        """Their document ids; the block's first documents may have none and are left out."""
        wanted = np.arange(max(first, self.without_id), last) - self.without_id
        return self.keys.select_many(wanted) + self.base if self.keys.low_bits <= 56 else self.doc_ids()[wanted]
