"""The corpus pipeline over ``documents``: every stage takes and returns whole tables.

``STAGES`` names the stages in order.  Each function takes (spark, docs, sf_dir) and returns
a DataFrame; ``run`` writes each result to the shared folder and reads it again, so a lost
executor never repeats an earlier stage.  All stages but the last return the columns of ``documents``.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; what a stage makes of them is told in its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstats.llm.language_id import UNKNOWN, fit_language_model, held_out, identify
from bagstats.llm.mixing import mix_sources
from bagstats.llm.pii import pseudonymize
from bagstats.llm.queries import CURRICULUM, PII_KEY
from bagstats.llm.segmentation import sample_segmentations
from bagstats.llm.superminhash import representatives
from bagstats.sources.shared import fresh_path

UNDECIDED = 0.35  # of a belief of 1 spread over the learned languages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that no language can be read from: null and empty texts, texts without a letter, and texts whose
    nearest codeword is ambiguous and has a score below ``UNDECIDED``.  ``lang`` stays as it was given."""
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = identify(docs, model)
    hopeless = (F.col("lang_pred") == UNKNOWN) | (F.col("lang_ambiguous") & (F.col("lang_score") < UNDECIDED))
    return found.filter(~hopeless).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group alike in 5-word shingles (80 %): the one with the smallest id, then text hash.

    Rows that share an id but not their text are told apart by the text.  Rows without id have one row of their own
    kept in each group.  Texts without words have no copies and all stay.
    """
    key = "__text_hash"  # not the name of a column that documents may bring
    kept = representatives(docs, shingle=5, percent=80).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = docs.filter(has_words).withColumn(key, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(key) == F.col("kept_hash"))
    chosen = hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return chosen.unionByName(docs.filter(~has_words))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by pseudonyms; ``n_chars`` follows the new text."""
    changed = pseudonymize(docs, PII_KEY)
    return _measured(changed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources: a document comes as often as it is used (not at all, once or twice), in training order.

    The one use in which its source's target is reached has only the words still missing; documents
    without words have no use.  ``n_chars`` follows the text.
    """
    names = ("__position", "__words")  # not those of columns that documents may bring
    mixed = mix_sources(docs, CURRICULUM, *names, total_ratio=1.5, max_repeats=2.0)
    return _measured(mixed.drop(*names))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every use of a document, with inclusion scores."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


def _measured(docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    size = F.char_length("text").cast(kind)
    return docs.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("private_data", private_data),
    ("mixture", mixture),
    ("segmentation", segmentation),
]

ORACLE_SQL = None  # learned languages and sampled segmentations are not expressible in SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
