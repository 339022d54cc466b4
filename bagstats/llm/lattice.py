"""Segmentation lattices of many short strings at once (numpy, used inside tasks).

A lattice has a node before, between and after the characters of a string and an edge for every
piece that fits; a character that is no piece gets one edge that stands for its bytes.  ``alpha`` of a
node is the logarithm of the summed probability of all ways to reach it, which is all that sampling
backwards from the end needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from bagstats.llm.memo import concat_ranges
from bagstats.llm.shingles import mix

SPACE = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_FILTER_BITS = 22


def _key(rolled: np.ndarray, size: int) -> np.ndarray:
    return mix(rolled + np.uint64(size * int(_STEP) % 2**64))


class Pieces:
    """Pieces of a SentencePiece model with the log probabilities of sampling.

    A unigram model brings log probabilities.  The scores of a BPE model are ranks; piece number ``r`` then gets
    a probability in proportion to ``1 / (r + 2)``, the usual fall of frequencies with rank.  A byte costs one
    more than the rarest piece.  Pieces of several characters that the model itself never uses (score below -1e8) are left out.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [
            i for i in range(sp.vocab_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
            and (sp.get_score(i) > -1e8 or len(sp.id_to_piece(i)) == 1)
        ]
        texts = [sp.id_to_piece(i) for i in usable]
        if any(SPACE in t[1:] for t in texts):
            raise ValueError("a piece with a blank inside: texts cannot be cut before blanks")
        self.newline_cuts = not any("\n" in t for t in texts)
        scores = np.array([sp.get_score(i) for i in usable])
        scores = np.maximum(scores, scores[scores > -1e8].min())
        ranked = len(scores) > 1 and bool((scores == np.round(scores)).all())
        logs = -np.log(2 - scores) if ranked else scores
        self.logs = logs - np.log(np.exp(logs).sum())
        self.byte_log = float(self.logs.min()) - 1.0
        self.ids = np.array(usable, np.int32)
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if (self.bytes == sp.unk_id()).any():
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, texts))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        of_size: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            of_size.setdefault(len(t), []).append(k)
        for size in range(1, self.longest + 1):
            members = np.array(of_size.get(size, []), np.int64)
            codes = np.frombuffer("".join(texts[k] for k in members).encode("utf-32-le"), np.uint32).reshape(-1, size)
            rolled = np.zeros(len(members), np.uint64)
            for t in range(size):
                rolled = rolled * _BASE + codes[:, t].astype(np.uint64) + np.uint64(1)
            keys = _key(rolled, size)
            order = np.argsort(keys)
            self.tables.append((keys[order], members[order]))
            self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Piece number of each key of a given size, -1 for none."""
        found = np.full(len(keys), -1, np.int64)
        known, members = self.tables[size - 1]
        if len(known):
            maybe = np.flatnonzero(self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
            found[maybe] = np.where(known[at] == keys[maybe], members[at], -1)
        return found


@dataclass
class Lattice:
    """Lattices of a list of strings; edges are grouped by the node they end in."""

    end: np.ndarray  # last node of each string
    begin: np.ndarray  # first node of each string
    alpha: np.ndarray  # per node
    first: np.ndarray  # first edge into each node
    degree: np.ndarray
    source: np.ndarray  # node each edge comes from
    piece: np.ndarray  # piece number, or -1 - code point for the bytes of a character
    log: np.ndarray
    upto: np.ndarray  # probability of this edge and the earlier ones of its node
    is_start: np.ndarray  # per node
    ways: np.ndarray  # per node: number of ways to reach it (as a float)

    @classmethod
    def of(cls, strings: list[str], pieces: Pieces) -> Lattice:
        sizes = np.array([len(s) for s in strings], np.int64)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        nodes = len(codes) + len(sizes)
        begin = np.cumsum(sizes + 1) - sizes - 1
        end = begin + sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        node = np.arange(len(codes)) + owner  # node before each character
        left = end[owner] - node  # characters from here to the end

        degree = np.zeros(nodes, np.int32)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        spots = np.arange(len(codes))
        rolled = np.zeros(len(codes), np.uint64)
        for size in range(1, pieces.longest + 1):
            keep = left[spots] >= size
            spots, rolled = spots[keep], rolled[keep]
            if not len(spots):
                break
            rolled = rolled * _BASE + codes[spots + size - 1] + np.uint64(1)
            piece = pieces.find(_key(rolled, size), size)
            if size == 1:
                piece = np.where(piece < 0, -1 - codes[spots].astype(np.int64), piece)
                at = np.arange(len(spots))
            else:
                at = np.flatnonzero(piece >= 0)
            target = node[spots[at]] + size
            degree[target] += 1
            found.append((target.astype(np.int32), piece[at].astype(np.int32), size))
        del codes, owner, node, left, spots, rolled

        first = np.cumsum(degree, dtype=np.int64) - degree
        count = int(degree.sum())
        source, number, log = np.empty(count, np.int32), np.empty(count, np.int32), np.empty(count)
        filled = first.copy()
        found.reverse()
        while found:  # each is gone when it is filed
            target, piece, size = found.pop()
            slot = filled[target]
            filled[target] += 1
            source[slot], number[slot] = target - size, piece
            known = piece >= 0
            width = np.ones(len(piece), np.int64)
            if not known.all():
                code = -1 - piece
                width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            log[slot] = np.where(known, pieces.logs[np.where(known, piece, 0)], pieces.byte_log * width)
        del filled

        alpha, upto, ways = np.zeros(nodes), np.empty(count), np.ones(nodes)
        order = np.argsort(-sizes, kind="stable")
        starts, longest_first = begin[order], sizes[order]
        for level in range(1, int(sizes.max(initial=0)) + 1):
            here = starts[: np.searchsorted(-longest_first, -level, "right")] + level
            deg = degree[here]
            edges = concat_ranges(first[here], deg)
            value = alpha[source[edges]] + log[edges]
            cuts = np.cumsum(deg) - deg
            top = np.maximum.reduceat(value, cuts)
            weight = np.exp(value - np.repeat(top, deg))
            total = np.add.reduceat(weight, cuts)
            alpha[here] = top + np.log(total)
            ways[here] = np.add.reduceat(ways[source[edges]], cuts)
            run = np.cumsum(weight / np.repeat(total, deg))
            upto[edges] = run - np.repeat(np.concatenate([[0.0], run])[cuts], deg)
        is_start = np.zeros(nodes, bool)
        is_start[begin] = True
        return cls(end, begin, alpha, first, degree, source, number, log, upto, is_start, ways)

    def share(self, edge: int, target: int) -> float:
        """Probability of an edge among the ways into its end."""
        return float(np.exp(self.alpha[self.source[edge]] + self.log[edge] - self.alpha[target]))

    def left_over(self, node: int, taken: list[list[int]]) -> float:
        """Probability of all ways into a node but those taken (edges from the end on), a sum without cancellation."""
        if not taken:
            return 1.0
        if self.is_start[node]:
            return 0.0
        total = 0.0
        for edge in range(int(self.first[node]), int(self.first[node] + self.degree[node])):
            tails = [way[1:] for way in taken if way[0] == edge]
            total += self.share(edge, node) * self.left_over(int(self.source[edge]), tails)
        return total

    def sample(self, which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact samples for the strings ``which``, drawn by the 64-bit ``keys``.

        Returns the number of edges of each, the edges from left to right, the log probability of each
        sample among all ways to write its string, and a hash of its path.
        """
        node = self.end[which]
        log = -self.alpha[node]
        path = np.zeros(len(which), np.uint64)
        sizes = np.zeros(len(which), np.int64)
        active = np.flatnonzero(~self.is_start[node])
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(active):
            turn = (turn + int(_STEP)) % 2**64
            at = node[active]
            draw = (mix(keys[active] + np.uint64(turn)) >> np.uint64(11)) * 2.0**-53
            edge = self.first[at]
            last = edge + self.degree[at] - 1
            open_ = np.flatnonzero((draw > self.upto[edge]) & (edge < last))
            while len(open_):
                edge[open_] += 1
                e = edge[open_]
                open_ = open_[(draw[open_] > self.upto[e]) & (e < last[open_])]
            taken.append((active, edge))
            log[active] += self.log[edge]
            path[active] += mix(edge.astype(np.uint64) + _STEP)
            sizes[active] += 1
            before = self.source[edge]
            node[active] = before
            active = active[~self.is_start[before]]
        edges = np.empty(int(sizes.sum()), np.int64)
        spot = np.cumsum(sizes) - 1
        for who, edge in taken:
            edges[spot[who]] = edge
            spot[who] -= 1
        return sizes, edges, np.minimum(log, 0.0), path
