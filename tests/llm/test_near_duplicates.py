import inspect
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bagstats.llm import superminhash
from bagstats.llm.components import components
from bagstats.llm.superminhash import near_duplicates, signatures


def _shingles(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _groups(rows, size, percent):
    """Brute force: (doc_id, set size, component, kept) of every row."""
    sets = [_shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[k] else doc
        out.append((doc, len(sets[k]), component, doc == component))
    return sorted(out, key=repr)


def _found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for size in (4, 5):
        assert _found(near_duplicates(odd, shingle=size)) == _groups(rows, size, 80)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 8, "cluster_rows": 6}])
def test_families_of_drifting_copies(spark, limits):
    rng = random.Random(1)
    rows = []
    for family in range(4):
        text = [f"w{family}x{rng.randrange(500)}" for _ in range(80)]
        for copy in range(25):
            if copy % 5:  # drifts away from the copy before it
                text = list(text)
                text[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
            rows.append((family * 100 + copy, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(near_duplicates(docs, shingle=4, **limits)) == _groups(rows, 4, 80)


def test_signature_estimates_with_less_variance_than_minhash():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(80):
        base = rng.integers(0, 2**63, 130, dtype=np.uint64)
        a, b = signatures([base[:115], base[15:]])
        errors.append((a == b).mean() - 100 / 130)
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < np.sqrt(100 / 130 * 30 / 130 / 96)


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 50, 700, 3000)]
    together = signatures(sets)
    assert all((signatures([s])[0] == t).all() for s, t in zip(sets, together, strict=True))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in found} == {(k, 0) for k in range(31)} | {(100 + k, 100) for k in range(40)}


def test_links_inside_a_cluster_are_verified_whatever_their_signatures():
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(4, dtype=np.uint64)]
    columns = {"low": [bytes([k] * 96) for k in range(3)], "n_shingles": [len(s) for s in sets], "own": [0] * 3, "i": [0] * 3, "j": [0] * 3, "hashes": [s.tobytes() for s in sets]}
    group = pa.RecordBatch.from_pydict(columns)
    links = superminhash._linked(group, superminhash._alike(group, 0.0, 0.8), 80)
    assert np.argwhere(links > 0).tolist() == [[0, 1], [1, 0]]


def test_a_pair_at_the_threshold_is_missed_below_one_in_a_hundred_thousand():
    least = math.ceil(inspect.signature(near_duplicates).parameters["likely"].default * superminhash.SLOTS)
    refused = sum(math.comb(96, k) * 0.8**k * 0.2 ** (96 - k) for k in range(least))
    assert refused + (1 - 0.8**superminhash.BAND_ROWS) ** (superminhash.SLOTS // superminhash.BAND_ROWS) < 1e-5


def test_components_of_hubs(spark):
    """Stars around the smallest, the largest and a middle node, joined in a chain."""
    edges = [(0, k) for k in range(1, 60)] + [(1000, 100 + k) for k in range(60)] + [(500, 2000 + k) for k in range(60)] + [(500, 300 + k) for k in range(60)]
    edges += [(59, 100), (159, 300)] + [(5000 + k, 5000 + k + 1) for k in range(5)]
    random.Random(3).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    nodes = {n for e in edges for n in e}
    assert {(r.node, r.component) for r in found} == {(n, 5000 if 5000 <= n else 0) for n in nodes} and len(found) == len(nodes)


def test_many_rows_without_id(spark):
    """2,000 different texts without id, in near pairs, and one of them 500 times: the work does not grow with their square."""
    rng = random.Random(8)
    rows = []
    for _ in range(1000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(None, " ".join(words)), (None, " ".join([*words[:-1], "other"]))]
    rows += [(7, rows[0][1]), *[(None, rows[2][1])] * 500]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()
    assert len(found) == len(rows)
    assert sum(r.component_id == 7 for r in found) == 3 and sum(r.component_id is None for r in found) == len(rows) - 3
    reps = superminhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert reps.count() == 1000 + 1  # one row of each pair, and of the named pair one with and one without id


@pytest.mark.parametrize("open_share", [0.0, 0.2])
def test_one_large_group(spark, monkeypatch, open_share):
    """5,000 near copies of one text, some of which are linked only by way of others: every block sees all that is open."""
    monkeypatch.setattr(superminhash, "BLOCK_SHINGLES", 1 << 16)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(5000):
        words = list(base)
        # at most 8 of 97 shingles differ for one change; two changes far apart on both sides may lose the direct link
        for _ in range(1 if rng.random() >= open_share else 4):
            words[rng.randrange(100)] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(10_000 + k, " ".join(f"x{k}y{j}" for j in range(40))) for k in range(50)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    wanted = _linked_to(rows, 4, 80)
    assert found == wanted


def _linked_to(rows, size, percent):
    """Components by counting shared shingles of all pairs (numpy)."""
    vocabulary = {}
    sets = [[vocabulary.setdefault(s, len(vocabulary)) for s in _shingles(t, size)] for _, t in rows]
    lengths = np.array([len(s) for s in sets])
    where = [[] for _ in vocabulary]
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = [np.array(w) for w in where if len(w) > 1]
    has = np.zeros((len(rows), len(common)), np.float32)
    for c, w in enumerate(common):
        has[w, c] = 1
    label = np.arange(len(rows))
    neighbours = []
    for at in range(0, len(rows), 500):
        shared = has[at : at + 500] @ has.T
        union = lengths[at : at + 500, None] + lengths[None, :] - shared
        neighbours += [np.flatnonzero(row) for row in shared * 100 >= percent * union]
    for start in range(len(rows)):
        if label[start] == start:
            waiting, seen = [start], {start}
            while waiting:
                k = waiting.pop()
                label[k] = start
                for n in neighbours[k].tolist():
                    if n not in seen:
                        seen.add(n)
                        waiting.append(n)
    return {rows[k][0]: rows[label[k]][0] for k in range(len(rows))}


def test_only_texts_in_clusters_meet_the_members(spark, monkeypatch):
    """Nearly all texts that are like no other are stopped where they are read, and groups are those of brute force."""
    rng = random.Random(9)
    rows = [(k if k % 50 else None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(600)]
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(20)] + [rows[0], (1, rows[5][1])]
    met = []

    def counted(*given, marked=superminhash.marked):
        found = marked(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(superminhash, "marked", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(near_duplicates(docs, shingle=4)) == _groups(rows, 4, 80)
    assert 40 <= met[0] < 120


def test_chains_in_a_block_leave_it_as_stars():
    nodes = [bytes([k]) * 16 for k in (9, 4, 7, 1, 8, 2)]
    columns = {"node": nodes, "team": [5] * 6, "i": [0] * 6, "j": [0] * 6}
    alike = np.zeros((6, 6), np.int16)
    for a, b in [(0, 1), (1, 2), (2, 4), (3, 5)]:  # a chain of four and a pair
        alike[a, b] = alike[b, a] = 90
    batches = superminhash._forests(iter([pa.RecordBatch.from_pydict(columns)]), lambda rows: alike)
    found = {(a[0], b[0]) for x in batches for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
    assert found == {(4, 9), (4, 7), (4, 8), (1, 2)}
