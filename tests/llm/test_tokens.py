import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bagstats.llm.elias_fano import EliasFano, TokenBlock, write_block
from bagstats.llm.memo import Memo, load_tokenizer
from bagstats.llm.token_counts import piece_counts, spliced_count, token_counts
from bagstats.llm.token_store import encode_words, read_token_store, write_token_store

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b", "the ", "'", "'re", "e", " ", "  ", "\n", " \n", "é", "😀", "1", "23", "!?", "<|endoftext|>", "<|endof",
         "text|>", "ing", "́", "\x1c", "\x85", " and", "\t", "Σ", "İ", "\x0b", "\xa0"]


def _texts(count, length):
    rng = random.Random(3)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, length))) for _ in range(count)]


def test_pieces_and_splices_give_the_count_of_the_whole_text():
    tokenizer = load_tokenizer(BYTES)
    memo = Memo(tokenizer, 300, keep_ids=False)
    texts = _texts(400, 120)
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert piece_counts(memo, pa.array(texts)).tolist() == want
    assert [spliced_count(tokenizer, t, 60, 24, 21)[0] for t in texts] == want


def test_overlaps_widen_where_nothing_aligns():
    tokenizer = load_tokenizer(BYTES)
    text = "a" * 3000 + " b" * 50 + " " * 2000 + "x" * 3000 + "<|endoftext|>" * 200
    count, widened = spliced_count(tokenizer, text, 100, 30, 21)
    assert count == len(tokenizer.encode(text, add_special_tokens=False)) and widened > 0


def test_token_counts_of_odd_rows(odd, empty):
    tokenizer = load_tokenizer(BYTES)
    got = token_counts(odd, BYTES, chunk_chars=5000, overlap_chars=200).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "").ids)) for r in odd.collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert token_counts(empty, BYTES).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd, BYTES, chunk_chars=100, overlap_chars=50)


def test_words_encode_like_the_whole_text():
    tokenizer = load_tokenizer(WORDS)
    texts = _texts(300, 60)
    got = []
    for _, sizes, ids in encode_words(Memo(tokenizer, 200, keep_ids=True), pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano_selects_what_was_stored():
    rng = np.random.default_rng(1)
    for top in (0, 1, 5, 10**6, 2**40, 2**63):
        for count in (0, 1, 2, 255, 256, 257, 900):
            values = np.sort(rng.integers(0, top, count, dtype=np.uint64, endpoint=True))
            data = EliasFano.of(values).to_bytes()
            found, end = EliasFano.from_bytes(memoryview(data))
            assert end == len(data) and (found.values() == values).all()
            for i in {0, count // 2, count - 1} if count else ():
                assert found.select(i) == values[i]
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([1])).select(1)


def test_boundaries_take_few_bits():
    sizes = np.random.default_rng(2).integers(1, 2000, 10_000)
    assert len(EliasFano.of(np.cumsum(sizes)).to_bytes()) * 8 / len(sizes) < 13  # 64-bit offsets take 64


def test_block_round_trip():
    ids = np.arange(10, dtype=np.uint32) * 7000
    block = TokenBlock(write_block(np.array([-5, 2, 2]), 1, np.array([4, 0, 5, 1]), ids, 4))
    assert [block.doc_id(k) for k in range(4)] == [None, -5, 2, 2]
    assert [block.ids(k).tolist() for k in range(4)] == [ids[:4].tolist(), [], ids[4:9].tolist(), ids[9:].tolist()]


def test_store_of_odd_rows(spark, odd, empty, tmp_path):
    tokenizer = load_tokenizer(WORDS)
    write_token_store(odd, str(tmp_path / "a"), WORDS, end_id=1, block_ids=500)
    rows = read_token_store(spark, str(tmp_path / "a")).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, [*tokenizer.encode(r.text or "").ids, 1]) for r in odd.collect()), key=repr)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows), key=repr)
    assert got == want
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    write_token_store(empty, str(tmp_path / "b"), WORDS, end_id=1)
    assert read_token_store(spark, str(tmp_path / "b")).count() == 0


def test_selects_of_many_places():
    rng = np.random.default_rng(5)
    for values in (np.sort(rng.integers(0, 10**6, 3000)), np.arange(700), np.repeat(7, 600), np.array([2**40]), np.cumsum(rng.integers(0, 2**45, 900))):
        found = EliasFano.of(values)
        wanted = rng.integers(0, len(values), 200)
        assert (found.select_many(wanted) == values[wanted]).all() and (found.select_many(np.arange(len(values))) == values).all()
        assert len(found.select_many(np.empty(0, int))) == 0
        with pytest.raises(IndexError):
            found.select_many(np.array([len(values)]))


def test_memo_keeps_what_is_asked_for_often():
    from bagstats.llm.memo import Memo

    class Counting:
        made = 0

        def encode_batch_fast(self, strings, add_special_tokens):
            Counting.made += len(strings)
            return [type("Found", (list,), {"ids": [ord(c) for c in s]})(s) for s in strings]

    memo = Memo(Counting(), 100, keep_ids=True)
    common = [f"c{k}" for k in range(40)]
    for turn in range(30):
        strings = pa.array([*common, *[f"r{turn}x{k}" for k in range(50)]])
        sizes, first, pool = memo(strings)
        assert ["".join(map(chr, pool[f : f + n])) for n, f in zip(sizes, first, strict=True)] == strings.to_pylist()
    assert Counting.made == 40 + 30 * 50 and len(memo.known) <= 140
