import re

import pytest
from pyspark.sql import functions as F

from bagstats.llm.mixing import _when, assign, mix_sources, schedule_area, word_count
from bagstats.llm.queries import CURRICULUM


def _size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def _targets(sizes, weights, total, repeats):
    """Water filling by repetition."""
    goal, capped = total * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in capped]
        left = goal - sum(capped.values())
        open_ = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        over = {s: repeats * sizes[s] for s in rest if open_[s] >= repeats * sizes[s]}
        if not over:
            return capped | open_
        capped |= over


def test_odd_rows(odd, empty):
    found = assign(odd, CURRICULUM).collect()
    rows = odd.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size)
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((r.doc_id or -1, _size(r.text)) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + _size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = _targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in order:
        mine = sorted((r for r in found if r.source == s), key=key)
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(r.target == pytest.approx(targets[s]) for r in mine)
        assert sum(r.taken for r in mine) == round(targets[s])
        assert all(r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses) for r in mine)
    assert assign(empty, CURRICULUM).count() == 0


def test_reruns_agree_whatever_the_partitions(odd):
    a = sorted(map(repr, assign(odd.repartition(7), CURRICULUM).collect()))
    assert a == sorted(map(repr, assign(odd.coalesce(1), CURRICULUM).collect()))


def test_mixed_rows_are_in_order_and_whole(odd):
    mixed = mix_sources(odd, CURRICULUM).drop("size", "key")
    rows = mixed.collect()
    want = {(r.doc_id, u.position, u.words) for r in assign(odd, CURRICULUM).collect() for u in r.uses}
    assert {(r.doc_id, r.position, r.words) for r in rows} == want
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(_size(r.text) == r.words for r in rows)
    texts = {r.text for r in odd.collect()}
    assert sum(r.text not in texts for r in rows) <= 5  # at most one cut use a source


def test_positions_invert_the_schedule(spark):
    for knots, weights in CURRICULUM + [((0.0, 0.3, 1.0), (0.0, 2.0, 0.0))]:
        total = schedule_area(knots, weights)

        def used(t, knots=knots, weights=weights):
            area = 0.0
            for a, b, x, y in zip(knots, knots[1:], weights, weights[1:]):
                d = min(max(t - a, 0), b - a)
                area += d * x + d * d * (y - x) / (b - a) / 2
            return area

        shares = [k / 40 for k in range(41)]
        df = spark.createDataFrame([(s,) for s in shares], "s double").select(_when(F.col("s"), knots, weights).alias("t"))
        assert [used(r.t) / total for r in df.collect()] == pytest.approx(shares, abs=1e-9)


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "\ta\x0bb\n", "a\xa0b c", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [_size(t) for t in texts]
