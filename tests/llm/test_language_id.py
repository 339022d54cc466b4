import numpy as np
import pytest
from pyspark.sql import functions as F

from bagstats.llm.language_id import codewords, fit_language_model, held_out, identify


def test_codewords_are_far_apart():
    for count in (2, 3, 4, 5, 9, 40):
        code = codewords(count)
        apart = min((code[a] != code[b]).sum() for a in range(count) for b in range(a))
        assert (np.abs(code.sum(0)) < count).all() or count == 2
        assert apart >= {2: 1, 3: 2, 4: 4}.get(count, code.shape[1] // 4)


def test_held_out_accuracy_and_no_peeking(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"))), sample_rows=200)
    hidden = docs.filter(held_out(F.col("doc_id")))
    rows = identify(hidden, model).select("doc_id", "lang", "lang_pred", "lang_score", "lang_ambiguous").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    blind = identify(hidden.select("text", F.lit("zz").alias("lang"), F.lit("s").alias("source"), "doc_id"), model).collect()
    assert {r.doc_id: r.lang_pred for r in blind} == {r.doc_id: r.lang_pred for r in rows}


def test_odd_rows(odd, empty):
    model = fit_language_model(odd)
    clash = odd.withColumn("lang_pred", F.lit(7))
    rows = identify(clash, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        readable = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not readable) and 0 <= r.lang_score <= 1
        if r.doc_id in (8, 9):
            assert r.lang_pred == "de"
    assert identify(empty, model).count() == 0
    assert fit_language_model(empty).languages == []
    assert {r.lang_pred for r in identify(odd, fit_language_model(empty)).collect()} == {"und"}
    single = fit_language_model(odd.filter("lang = 'de'"))
    assert {(r.lang_pred, r.lang_score) for r in identify(odd.filter("doc_id = 10"), single).collect()} == {("de", 1.0)}


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("text", ["Ärger", "12 x"])
def test_repeated_texts_agree(spark, odd, text):
    model = fit_language_model(odd)
    docs = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string").repartition(3)
    assert len({(r.lang_pred, r.lang_score) for r in identify(docs, model).collect()}) == 1
