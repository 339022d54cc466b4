import re

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# A few of every kind; the check tool compares all of them.
SAMPLE = [
    "A10_accuracy_suite",
    "A14_auroc",
    "A19_roc_curve",
    "A25_per_fold_and_pooled",
    "A27_bootstrap_ci",
    "B3_cap_spatial_sqrt",
    "B5_cap_spatial_even",
    "L4_attention_pool",
    "L7_score_bags",
    "Q1_validate_bags",
    "R2_stream_ingest_diff",
    "S5_bag_index",
    "W1_kfold_with_test",
    "W5_monte_carlo_split",
    "W9_length_bucket_batches",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _sorted(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


def test_every_oracle_belongs_to_a_query():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries)
    # The training-data queries, where present, are held against brute force in their own folder of tests.
    own = {n for n in queries if not re.match(r"op[0-9]+_|pipeline$", n)}
    assert own - set(oracles) == {"L10_linear_probe_cv"}


def test_entry(spark):
    assert registry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(registry.oracle_sql()[name])
    want = _sorted([d[0] for d in result.description], result.fetchall())
    assert got == want
