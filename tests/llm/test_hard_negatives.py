import random

import numpy as np
import pytest

from bagstats.llm import hard_negatives as module
from bagstats.llm.hard_negatives import NEGATIVE, POSITIVE, hard_negatives, pack, unpack, windows

SHAPE = "vec_id long, label int, x array<long>, is_anchor boolean"


def _brute(rows, positives=5, negatives=10, low=30, high=90):
    """Pairwise, over rows (id, label, vector, asks) that take part."""
    rows = [r for r in rows if None not in r[:3] and len(r[2]) and None not in r[2]]
    single = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        single.setdefault(r[0], r)
    asking = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if r[3]:
            asking.setdefault(r[0], r)
    out = []
    for a in asking.values():
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in single.values() if r[0] != a[0])
        best = [(ident, -s) for s, ident, same in scored if same][:positives]
        for ident, p in best:
            fits = [(n, -s) for s, n, same in scored if not same and low * p <= -100 * s <= high * p][:negatives]
            out += [(a[0], ident, k + 1, n, p, s) for k, (n, s) in enumerate(fits)]
    return sorted(out)


def _found(spark, rows, **options):
    table = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(table, **options).collect())


def test_keys_keep_the_order():
    rng = random.Random(1)
    numbers = [-(2**63) + 1, -5, -1, 0, 1, 7, 2**62]
    rows = [(rng.choice(numbers), rng.choice(numbers), rng.choice([POSITIVE, NEGATIVE]), rng.choice(numbers)) for _ in range(200)]
    keys = [pack(np.array([a]), np.array([s]), k, np.array([i]))[0].as_py() for a, s, k, i in rows]
    assert [unpack(k) for k in keys] == rows
    assert [unpack(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_windows_open_and_close():
    def key(anchor, score, kind, ident):
        return pack(np.array([anchor]), np.array([score]), kind, np.array([ident]))[0].as_py(), None

    keys = [key(1, 100, POSITIVE, 5), key(1, 95, NEGATIVE, 6), key(1, 90, NEGATIVE, 7), key(1, 40, POSITIVE, 8), key(1, 36, NEGATIVE, 9)]
    keys += [key(1, 30, NEGATIVE, 10), key(1, 29, NEGATIVE, 11), key(1, 12, NEGATIVE, 12), key(1, 11, NEGATIVE, 13), key(2, 20, NEGATIVE, 1)]
    found = list(windows(iter(keys), 2, 30, 90))
    assert found == [(1, 5, 1, 7, 100, 90), (1, 5, 2, 9, 100, 36), (1, 8, 1, 9, 40, 36), (1, 8, 2, 10, 40, 30)]


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
@pytest.mark.parametrize("spread", [3, 300, 20_000, 60_000_000])
def test_agrees_with_brute_force(spark, monkeypatch, blocks, spread):
    """Small numbers make ties and zeros, large ones leave the 32- and 53-bit ranges."""
    monkeypatch.setattr(module, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(module, "ANCHOR_BLOCK", blocks[1])
    rng = random.Random(spread)
    rows = [(k, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-spread // 3, spread) for _ in range(6)], k % 9 == 0) for k in range(120)]
    found = _found(spark, rows)
    assert found == _brute(rows) and len(found) > 100


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, other lengths, one label for all, and no rows at all."""
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 1]), [rng.randint(0, 4) for _ in range(4)], k % 5 == 0) for k in range(40)]
    rows += [rows[0], rows[5], (3, 0, [9, 9, 9, 9], False), (10, 0, [0, 0, 0, 1], True), (None, 0, [1, 1, 1, 1], True), (50, None, [1, 1, 1, 1], True)]
    rows += [(51, 1, None, True), (52, 1, [], True), (53, 1, [1, None, 1, 1], True), (54, 0, [1, 2, 3, 4], None)]
    assert _found(spark, rows) == _brute(rows)
    assert _found(spark, [*rows, (60, 1, [1, 2], True)]) == _brute(rows)  # another length takes no part
    assert _found(spark, [(k, 0, [k], True) for k in range(5)]) == []
    assert _found(spark, [(1, 0, [0, 0], True), (2, 0, [1, 1], False), (0, 1, [5, 5], False)]) == [(1, 2, 1, 0, 0, 0)]
    assert hard_negatives(spark.createDataFrame([], SHAPE)).count() == 0
    renamed = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS id", "2 AS key", "3 AS i", "4 AS j", "5 AS asks", "6 AS scores")
    assert sorted(tuple(r) for r in hard_negatives(renamed).collect()) == _brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives(spark.createDataFrame([(1, 0, [2**40], True)], SHAPE))


def test_other_numbers_of_positives_and_negatives(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, 1]), [rng.randint(0, 9) for _ in range(5)], k % 4 == 0) for k in range(60)]
    assert _found(spark, rows, positives=2, negatives=3, low=50, high=100) == _brute(rows, 2, 3, 50, 100)


def test_nothing_grows_with_an_anchors_rows(spark):
    """A block passes on at most positives, and negatives for each of them: far fewer keys than pairs."""
    rng = random.Random(2)
    rows = [(k, k % 2, [rng.randint(0, 9) for _ in range(8)], k < 4) for k in range(2000)]
    assert len(_found(spark, rows)) == 4 * 5 * 10
