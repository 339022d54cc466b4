import collections
import re
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from bagstats.llm import segmentation
from bagstats.llm.lattice import Pieces
from bagstats.llm.memo import handed_back
from bagstats.llm.segmentation import _other_path, Lattice, decoded, sample_segmentations, segmentations_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _every(text, pieces, sp):
    """All segmentations of a text and their log probabilities."""
    known = {sp.id_to_piece(int(i)): k for k, i in enumerate(pieces.ids)}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                for tail, log in ways(rest[n:]):
                    yield (int(pieces.ids[known[rest[:n]]]), *tail), log + pieces.logs[known[rest[:n]]]

    found = dict(ways("▁" + text.replace(" ", "▁")))
    whole = np.logaddexp.reduce(list(found.values()))
    return {k: v - whole for k, v in found.items()}


def _samples(text, pieces, count, k):
    keys = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = collections.defaultdict(list)
    for spot, _, ids, sizes, log, value, score in segmentations_of(pa.array([text] * count), keys, pieces, k):
        cut = np.split(ids, np.cumsum(sizes)[:-1])
        for row, *found in zip(spot, cut, log, value, score, strict=True):
            out[int(row)].append((tuple(found[0].tolist()), *found[1:]))
    return out


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_distinct_samples_have_right_scores(pieces, sp, k):
    every = _every("ab cat", pieces, sp)
    rows = _samples("ab cat", pieces, 4000 if k <= 5 else 150, k)
    estimate = collections.Counter()
    for found in rows.values():
        assert len({s for s, *_ in found}) == len(found) == min(k, len(every))
        assert all(log == pytest.approx(every[s]) for s, log, _, _ in found)
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)
        for s, _, _, score in found:
            estimate[s] += np.exp(-score) / len(rows)
    for s, log in every.items():  # inclusion scores make counts unbiased
        if np.exp(log) > 0.02:
            assert estimate[s] == pytest.approx(1.0, abs=0.12)
    first = collections.Counter(found[0][0] for found in rows.values())
    for s, log in every.items():
        assert first[s] / len(rows) == pytest.approx(np.exp(log), abs=0.03)


def test_rare_ways_are_sampled_exactly(pieces):
    lattice = Lattice.of(["▁cat"], pieces)
    taken = []
    for k in range(6):
        edges = _other_path(lattice, 0, taken, k)
        assert all(len(edges) != len(t) or (edges != t).any() for t in taken)
        taken.append(edges)


def test_texts_round_trip(spark, pieces):
    texts = ["", " ", "  two  blanks ", "a\nb é①\t", "\x00 z", "Grüße 😀 " * 30, "x" * 3000, "one\n\ntwo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decoded(sample_segmentations(docs, MODEL, k=3), MODEL).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_same_draws_in_any_company(spark, odd):
    few = sample_segmentations(odd.filter("doc_id in (1, 11)").repartition(5), MODEL, k=2).collect()
    many = {(r.doc_id, r.sample): r for r in sample_segmentations(odd.coalesce(1), MODEL, k=2).collect()}
    for r in few:
        other = many[r.doc_id, r.sample]
        assert other.ids == r.ids and other.perturbed == pytest.approx(r.perturbed) and other.log_inclusion == pytest.approx(r.log_inclusion)


def test_odd_rows(odd, empty):
    rows = sample_segmentations(odd, MODEL, k=2).collect()
    counts = collections.Counter((r.doc_id, r.sample) for r in rows)
    assert counts[None, 1] == 2 and counts[2, 1] == 2 and counts[4, 1] == 1 and counts[13, 2] == 1
    assert {tuple(r.ids) for r in rows if r.doc_id in (4, 5)} == {()}
    assert all(r.log_inclusion <= 0 and r.log_prob <= 0 for r in rows)
    assert sample_segmentations(empty, MODEL).count() == 0


def test_a_long_word_in_the_slice_changes_nothing(pieces):
    """The rest of a text such as "a" is faint, and a word of more than 300 pieces may stand beside it."""
    keys = np.arange(3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def rows(texts):
        out = collections.defaultdict(list)
        for spot, _, ids, sizes, log, value, score in segmentations_of(pa.array(texts), keys[: len(texts)], pieces, 2):
            for at, *found in zip(spot, np.split(ids, np.cumsum(sizes)[:-1]), value, score, strict=True):
                out[int(at)].append((found[0].tolist(), *map(float, found[1:])))
        return out

    alone, beside = rows(["a", "t"]), rows(["a", "t", "x" * 3000])
    assert len(alone[0]) == len(alone[1]) == 2
    assert beside[0] == alone[0] and beside[1] == alone[1]


def test_one_slice_is_gone_before_the_next(pieces, monkeypatch):
    """A task holds the arrays of one slice, however many slices it works off, and a slice takes less than 150 bytes a character."""
    monkeypatch.setattr(segmentation, "SLICE_CHARS", 40_000)
    letters = np.random.default_rng(1).integers(97, 123, (64, 4_000)).astype(np.uint8)
    letters[:, ::8] = 32
    texts = [bytes(x).decode() for x in letters]

    def most(given):
        tracemalloc.start()
        for _ in segmentations_of(pa.array(given), np.arange(len(given), dtype=np.uint64), pieces, 2):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    most(texts[:9])  # what is made once
    one, many = most(texts[:9]), most(texts)
    assert many < 1.25 * one
    assert one < 150 * 9 * 4_000


def test_slices_change_no_draw(pieces, monkeypatch):
    texts = pa.array([f"some words of text {k} and others " * 20 for k in range(50)])
    keys = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def rows(size):
        monkeypatch.setattr(segmentation, "SLICE_CHARS", size)
        out = {}
        for spot, sample, ids, sizes, *numbers in segmentations_of(texts, keys, pieces, 2):
            for at, found, *own in zip(spot, np.split(ids, np.cumsum(sizes)[:-1]), *numbers, strict=True):
                out[int(at), sample] = (found.tolist(), own)
        return out

    small, large = rows(1_000), rows(10**6)
    assert small.keys() == large.keys() and len(large) == 100
    assert all(small[k][0] == large[k][0] and small[k][1] == pytest.approx(large[k][1], abs=1e-9) for k in large)


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_workers_give_memory_back():
    """Freed blocks below one that is still held stay with the process unless they are given back."""

    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    kept = []

    def task():
        blocks = [np.ones(8_000) for _ in range(3_000)]
        kept.append(np.ones(8_000))
        yield len(blocks)

    before = held()
    assert list(handed_back(task())) == [3_000]
    assert held() - before < 60  # of 192
