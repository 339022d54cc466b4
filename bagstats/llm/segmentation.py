"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

A text's segmentations have the probabilities of its lattice.  Adding independent Gumbel noise to
their log probabilities and taking the ``k`` largest gives ``k`` distinct segmentations, sampled without
replacement.  The search never lists them: it keeps a set of disjoint parts of the space, each with the maximum
of its perturbed log probabilities, and always opens the part with the largest maximum (A* search).  The
maximum of a part is Gumbel distributed around the log of the part's probability and cut off at its
parent's value; where it lies is an exact sample of the part.  When a segmentation is taken, what is left
of its part splits by the first word that differs.  Words are independent, as no piece runs over a
blank, so a part is described by one word and everything in it is sampled for many texts at once.

The inclusion score of a segmentation is the probability that its perturbed value passes the largest
one not taken; dividing by it makes sums over the samples unbiased.  It is given as a logarithm, as a long
text's segmentations are all very improbable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.llm.lattice import SPACE, Lattice, Pieces
from bagstats.llm.memo import concat_ranges, handed_back
from bagstats.llm.shingles import mix

SLICE_CHARS = 400_000  # bounds the arrays of a task; it changes no draw
CUT = "\x00"
TRIES = 32
DUST = 1e-9  # a rest below this is not taken from a difference
MOST_EDGES = 300  # of a way in such a sum; a longer word always leaves more than dust
_A, _B, _C, _D = (np.uint64(x) for x in (  # odd multipliers without meaning
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93
))
_workers: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def _times(number: int, factor: np.uint64) -> np.uint64:
    return np.uint64(number * int(factor) % 2**64)


def _uniform(keys: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def words_of(texts: pa.Array, newline_cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """Words of every text, each with the blank before it, and the place of each text's first; no text is null.

    A text that holds the cut mark itself is one word: cutting only saves work.
    """
    marked = pc.match_substring(texts, CUT)
    blank = pc.replace_substring(texts, " ", SPACE)
    whole = pc.binary_join_element_wise(pa.scalar(SPACE), blank, "")
    cut = pc.replace_substring(whole, SPACE, CUT + SPACE)
    if newline_cuts:
        cut = pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}")
    # no text at all has no word, not even the blank that is put before a text
    empty = pc.equal(pc.binary_length(texts), 0)
    lists = pc.split_pattern(pc.if_else(empty, "", pc.if_else(marked, "", cut)), CUT)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    offsets = np.concatenate([[0], np.cumsum(filled)])[ends].astype(np.int64)
    words = words.filter(pa.array(filled))
    if pc.any(marked).as_py():
        own = [whole.slice(k, 1) if marked[k].as_py() else words.slice(offsets[k], offsets[k + 1] - offsets[k]) for k in range(len(texts))]
        words = pa.concat_arrays(own)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return words, offsets


def _other_path(lattice: Lattice, word: int, taken: list[np.ndarray], key: int) -> np.ndarray:
    """One exact sample of a word's paths other than those taken (edges from left to right), edge by edge from the end."""
    node, edges, turn = int(lattice.end[word]), [], key
    rest = [t[::-1].tolist() for t in taken]
    while not lattice.is_start[node]:
        incoming = range(int(lattice.first[node]), int(lattice.first[node] + lattice.degree[node]))
        tails = {e: [way[1:] for way in rest if way[0] == e] for e in incoming}
        run = np.cumsum([lattice.share(e, node) * lattice.left_over(int(lattice.source[e]), tails[e]) for e in incoming])
        turn = int(mix(np.array([turn], np.uint64) + _D)[0])
        spot = int(np.searchsorted(run, _uniform(np.array([turn], np.uint64))[0] * run[-1]))
        edges.append(incoming[min(spot, len(incoming) - 1)])
        rest = tails[edges[-1]]
        node = int(lattice.source[edges[-1]])
    return np.array(edges[::-1], np.int64)


class _Search:
    """The search over one slice of texts, all at once."""

    def __init__(self, lattice: Lattice, codes: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.lattice, self.codes, self.offsets, self.keys = lattice, codes, offsets, keys
        self.counts = np.diff(offsets)
        self.text = np.repeat(np.arange(len(keys)), self.counts)
        self.place = np.arange(len(codes)) - offsets[:-1][self.text]
        self.pool = np.empty(0, np.int64)
        # per sample: first edge and number of edges in the pool, log probability and path of every word
        self.first: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.log: list[np.ndarray] = []
        self.path: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []  # per sample: maximum of the part in which this word differs first
        self.value: list[np.ndarray] = []  # per sample and text: perturbed log probability, -inf if there is none
        self.known: dict[tuple[int, ...], float] = {}
        self.barred: list[tuple[np.ndarray, ...]] = []  # per sample after the first: what it was split from

    def _draw(self, words: np.ndarray, number: int, again: int = 0) -> tuple[np.ndarray, ...]:
        keys = self.keys[self.text[words]] + self.place[words].astype(np.uint64) * _A
        keys = mix(keys + _times(number + 1, _B) + _times(again, _C))
        size, edges, log, path = self.lattice.sample(self.codes[words], keys)
        first = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, edges])
        return first, size, log, path

    def _cut_gumbel(self, mass: np.ndarray, limit: np.ndarray, words: np.ndarray, number: int) -> np.ndarray:
        """Maxima of parts with the given log probability, cut off at their parents' values."""
        draw = _uniform(self.keys[self.text[words]] ^ mix(self.place[words].astype(np.uint64) * _C + _times(number + 1, _D)))
        found = np.full(len(mass), -np.inf)
        some = mass > -np.inf
        found[some] = mass[some] - np.log(np.exp(mass[some] - limit[some]) - np.log(draw[some]))
        return found

    def _left(self, words: np.ndarray, ways: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Log probability of all ways of each word but those given (mask, first edge, edges, log probability, path).

        Where almost nothing is left the difference from 1 is rounding dust; there the rest is summed
        edge by edge, once for each set of ways.
        """
        gone, number = np.zeros(len(words)), np.zeros(len(words))
        for same, _, _, log, _ in ways:
            gone += np.where(same, np.exp(log), 0.0)
            number += same
        rest = 1.0 - gone
        nodes = self.lattice.end[self.codes[words]]
        more = self.lattice.ways[nodes] > number
        found = np.where(more & (rest > DUST), np.log(np.maximum(rest, DUST)), -np.inf)
        longest = np.zeros(len(words), np.int64)  # of each word's own ways, so that no other word counts
        for same, _, size, _, _ in ways:
            longest = np.maximum(longest, np.where(same, size, 0))
        for k in np.flatnonzero(more & (rest <= DUST) & (longest <= MOST_EDGES)):
            mark = (int(nodes[k]), *sorted(int(path[k]) for same, *_, path in ways if same[k]))
            if mark not in self.known:
                taken = [self.pool[int(f[k]) : int(f[k]) + int(n[k])][::-1].tolist() for same, f, n, _, _ in ways if same[k]]
                value = self.lattice.left_over(int(nodes[k]), taken)
                self.known[mark] = float(np.log(value)) if value > 0 else -np.inf
            found[k] = self.known[mark]
        return found

    def _before(self, log: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(log)])
        return run[:-1] - run[self.offsets[:-1]][self.text]

    def start(self) -> None:
        words = np.arange(len(self.codes))
        for kept, found in zip((self.first, self.size, self.log, self.path), self._draw(words, 0), strict=True):
            kept.append(found)
        self.value.append(-np.log(-np.log(_uniform(self.keys ^ _B))))
        self._open(0, np.zeros(len(self.keys), np.int64))

    def _open(self, sample: int, begin: np.ndarray) -> None:
        """Split what is left around a sample by the first word that differs, from word ``begin`` of each text on."""
        parts = np.full(len(self.codes), -np.inf)
        words = np.flatnonzero((self.place >= begin[self.text]) & (self.value[sample] > -np.inf)[self.text])
        own = (np.ones(len(words), bool), *(x[sample][words] for x in (self.first, self.size, self.log, self.path)))
        mass = self._before(self.log[sample])[words] + self._left(words, [own])
        parts[words] = self._cut_gumbel(mass, self.value[sample][self.text[words]], words, sample)
        self.parts.append(parts)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: largest maximum of its parts, the sample it belongs to and its word."""
        value = np.full(len(self.keys), -np.inf)
        sample = np.zeros(len(self.keys), np.int64)
        word = np.zeros(len(self.keys), np.int64)
        filled = np.flatnonzero(self.counts > 0)
        if not len(filled):
            return value, sample, word
        for s, parts in enumerate(self.parts):
            top = np.maximum.reduceat(parts, self.offsets[:-1][filled])
            better = top > value[filled]
            value[filled[better]], sample[filled[better]] = top[better], s
            high = np.full(len(self.keys), np.inf)
            high[filled[better]] = top[better]
            spots = np.flatnonzero(parts == high[self.text])
            word[self.text[spots[::-1]]] = spots[::-1]
        return value, sample, word

    def next(self) -> None:
        """Take the best part of every text: one more sample each."""
        number = len(self.value)
        value, base, split = self.best()
        live = np.flatnonzero(value > -np.inf)
        # start from the sample that the part belongs to
        columns = []
        for kept in (self.first, self.size, self.log, self.path):
            merged = kept[0].copy()
            for s in range(1, number):
                here = (base == s)[self.text]
                merged[here] = kept[s][here]
            columns.append(merged)
        fresh = np.flatnonzero((value > -np.inf)[self.text] & (np.arange(len(self.codes)) > split[self.text]))
        for merged, found in zip(columns, self._draw(fresh, number), strict=True):
            merged[fresh] = found
        self._split_words(number, live, value, base, split, columns)
        for kept, merged in zip((self.first, self.size, self.log, self.path), columns, strict=True):
            kept.append(merged)
        self.value.append(value)
        begin = np.where(value > -np.inf, split - self.offsets[:-1] + 1, 0)
        self._open(number, begin)

    def _gone(self, live: np.ndarray, base: np.ndarray, split: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per text the ways of its split word that are used up: the sample's own and earlier splits of the same part."""
        own = [np.choose(base[live], [x[split[live]] for x in kept]) if len(kept) > 1 else kept[0][split[live]]
               for kept in (self.first, self.size, self.log, self.path)]
        gone = [(np.ones(len(live), bool), *own)]
        for texts, at_base, at_split, *way in self.barred:
            spot = np.searchsorted(texts, live)
            spot = np.minimum(spot, max(0, len(texts) - 1))
            same = (texts[spot] == live) if len(texts) else np.zeros(len(live), bool)
            if len(texts):
                same &= (at_base[spot] == base[live]) & (at_split[spot] == split[live])
                gone.append((same, *[w[spot] for w in way]))
        return gone

    def _split_words(self, number: int, live: np.ndarray, value: np.ndarray, base: np.ndarray, split: np.ndarray, columns: list[np.ndarray]) -> None:
        """Draw another way for the split word of each text, and cut down the part it came from."""
        gone = self._gone(live, base, split)
        waiting = np.arange(len(live))
        for again in range(1, TRIES + 1):
            if not len(waiting):
                break
            words = split[live[waiting]]
            found = self._draw(words, number, again)
            fine = np.ones(len(waiting), bool)
            for same, *_, path in gone:
                fine &= ~(same[waiting] & (path[waiting] == found[3]))
            for merged, drawn in zip(columns, found, strict=True):
                merged[words[fine]] = drawn[fine]
            waiting = waiting[~fine]
        for k in waiting:  # a rare way: sample it edge by edge among those not used up
            word = int(split[live[k]])
            taken = [self.pool[int(f[k]) : int(f[k]) + int(n[k])] for same, f, n, _, _ in gone if same[k]]
            edges = _other_path(self.lattice, int(self.codes[word]), taken, int(self.keys[live[k]]) ^ number)
            log = float(self.lattice.log[edges].sum() - self.lattice.alpha[self.lattice.end[self.codes[word]]])
            path = mix(edges.astype(np.uint64) + _A).sum(dtype=np.uint64)
            for merged, found in zip(columns, (len(self.pool), len(edges), min(log, 0.0), path), strict=True):
                merged[word] = found
            self.pool = np.concatenate([self.pool, edges])
        words = split[live]
        self.barred.append((live, base[live], words, *[c[words] for c in columns]))
        gone.append((np.ones(len(live), bool), *[c[words] for c in columns]))
        before = np.choose(base[live], [self._before(x)[words] for x in self.log]) if len(self.log) > 1 else self._before(self.log[0])[words]
        cut = self._cut_gumbel(before + self._left(words, gone), value[live], words, number * 7919 + 13)
        for s, parts in enumerate(self.parts):
            here = base[live] == s
            parts[words[here]] = cut[here]

    def ids(self, sample: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sample for every text that has it, and their number per text."""
        has = (self.value[sample] > -np.inf)[self.text]
        size = np.where(has, self.size[sample], 0)
        edges = self.pool[concat_ranges(self.first[sample][has], self.size[sample][has])]
        piece = self.lattice.piece[edges]
        known = piece >= 0
        ids = np.where(known, pieces.ids[np.where(known, piece, 0)], 0)
        width = np.ones(len(piece), np.int64)
        code = -1 - piece
        small = ~known & (code < 128)
        ids[small] = pieces.bytes[code[small]]
        wide = np.flatnonzero(~known & (code >= 128))
        owner = np.repeat(self.text, size)
        if len(wide):
            spelled = [list(chr(int(code[k])).encode("utf-8", "surrogatepass")) for k in wide]
            width[wide] = [len(b) for b in spelled]
            starts = np.cumsum(width) - width
            ids = np.repeat(ids, width)
            for k, b in zip(wide, spelled, strict=True):
                ids[starts[k] : starts[k] + len(b)] = pieces.bytes[b]
            owner = np.repeat(owner, width)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(self.keys))


def segmentations_of(texts: pa.Array, keys: np.ndarray, pieces: Pieces, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice and sample: place of each text, sample number, ids, ids per text, log probability, perturbed value, log of the inclusion score."""
    lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(lengths, lengths[begin] + SLICE_CHARS, "right")) - 1)
        # in a call of its own: the arrays of one slice are gone before those of the next are made
        for spots, *found in _of_slice(texts.slice(begin, end - begin), keys[begin:end], pieces, k):
            yield begin + spots, *found
        begin = end


def _of_slice(texts: pa.Array, keys: np.ndarray, pieces: Pieces, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    words, offsets = words_of(texts, pieces.newline_cuts)
    coded = words.dictionary_encode()
    del words
    lattice = Lattice.of(coded.dictionary.to_pylist(), pieces)
    search = _Search(lattice, coded.indices.to_numpy().astype(np.int64), offsets, keys)
    del coded
    search.start()
    while len(search.value) < k and (search.value[-1] > -np.inf).any():
        search.next()
    limit = search.best()[0]
    for s, value in enumerate(search.value):
        has = np.flatnonzero(value > -np.inf)
        if not len(has):
            continue
        ids, counts = search.ids(s, pieces)
        total = np.bincount(search.text, weights=search.log[s], minlength=len(texts))[has]
        over = np.where(limit[has] > -np.inf, np.minimum(total - limit[has], 50.0), 50.0)
        score = np.where(over < -30, over, np.log(-np.expm1(-np.exp(np.maximum(over, -30)))))
        yield has, s + 1, ids, counts[has], total, value[has], score


def sample_segmentations(
    docs: DataFrame, model_path: str, k: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, sample, ids, log_prob, perturbed, log_inclusion``: up to ``k`` distinct segmentations of every whole text.

    ``sample`` counts from 1 in descending perturbed value.  Draws depend on the seed, the row's id and the
    text's words alone, so reruns and repeated rows agree.  A text with fewer segmentations gets all of
    them, with inclusion score 1; a null or empty text has the one empty segmentation.  Null ids share a key; other columns are
    ignored; an empty table gives an empty result.  Nothing is shuffled.
    """
    start = np.uint64(seed % 2**64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            row = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for spot, number, ids, counts, log, value, score in segmentations_of(texts, mix(row + start), pieces, k):
                ends = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                numbers = pa.array(np.full(len(spot), number, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(spot)), numbers, lists, pa.array(log), pa.array(value), pa.array(score)],
                    names=[id_col, "sample", "ids", "log_prob", "perturbed", "log_inclusion"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return rows.mapInArrow(lambda batches: handed_back(sample(batches)), f"`{id_col}` {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double")


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns and the text of ``ids_col``; null ids give null, no ids the empty text."""

    def decode(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for given in column:
            yield pa.array([None if x is None else sp.decode(x) if x else "" for x in given.to_pylist()], pa.string())

    decode.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [F.col(f"`{c}`") for c in rows.columns if c != text_col]
    return rows.select(*kept, F.arrow_udf(decode, "string")(F.col(ids_col)).alias(text_col))
