import collections
import re

import corpus_pipeline
import __spark_entry__ as registry
from test_near_duplicates import _groups


def _columns(df):
    return df.columns


def test_stages_chain_on_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "unused").write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if name == "language":
            assert {r.doc_id for r in found.collect()} == {1, 2, 3, 8, 9, 10, 11, 12, 13, 14, None}
        if name == "near_copies":
            ids = sorted((r.doc_id for r in found.collect()), key=repr)
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            kept = {d for d, size, _, keep in _groups(rows, 5, 80) if keep and size}
            assert ids == sorted([*[k for k in kept if k is not None], None], key=repr)
        if name == "private_data":
            assert found.count() == docs.count()
            assert not any("4111111111111111" in r.text for r in found.collect())
        if name == "mixture":
            uses = collections.Counter(r.doc_id for r in found.collect())
            assert max(uses.values()) <= 2 and set(uses) <= {r.doc_id for r in docs.collect()}
            taken = sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in found.collect())
            size = sum(len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in docs.collect())
            assert abs(taken - 1.5 * size) <= 5
        if name != "segmentation":
            assert _columns(found) == _columns(odd)
            assert all(r.n_chars == len(r.text) for r in found.collect() if r.text is not None)
        docs = found
    assert docs.count() > 0


def test_stages_take_empty_tables(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0


def test_clean_documents_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.count() >= 0.99 * docs.count()


def test_queries_are_registered():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_near_copies_of_repeated_and_missing_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    rows = [(1, texts[0]), (7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (9, texts[1] + " more"), (None, texts[3]), (None, texts[3]), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "unused").collect()), key=repr)
    want = [(1, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[3]), (None, texts[4]), (None, None)]
    assert found == sorted(want, key=repr)
