"""Checks that are made while a table is written.

A check is an aggregate over the rows, so any number of checks is composed into one row of metrics, which Spark gathers in the very
pass that writes the table (``DataFrame.observe``).  Nothing is read twice, and the table counts as published only when its
report stands next to it and names no violation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bagstats.functions.probs import prob_columns

REPORT = "rule string, violations bigint, n_rows bigint"


class ValidationError(Exception):
    """A table that was written does not keep its rules."""


@dataclass(frozen=True)
class Check:
    """A rule and an aggregate that counts what breaks it."""

    rule: str
    broken: Column


def not_empty() -> Check:
    return Check("not empty", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0))


def no_nans(df: DataFrame, columns: Sequence[str] | None = None) -> list[Check]:
    """One check per column (by default the probability columns): rows with NaN or null."""
    names = list(columns) if columns is not None else prob_columns(df)
    if not names:
        raise ValueError(f"No columns to check. Available: {df.columns}")
    number = {c: F.col(c).cast("double") for c in names}
    return [Check(f"no NaN in {c}", F.count_if(F.isnan(v) | v.isNull())) for c, v in number.items()]


def holds(rule: str, predicate: Column | str) -> Check:
    """Every row keeps the predicate; a null counts as not kept."""
    kept = F.expr(predicate) if isinstance(predicate, str) else predicate
    return Check(rule, F.count_if(~F.coalesce(kept, F.lit(False))))


def whole_patches(feat_dim: int) -> list[Check]:
    """The checks of patches that need no other row: features of the given length, coordinates, and no NaN among the features."""
    values = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
    return [
        holds("features present", F.col("features").isNotNull()),
        holds("coordinates present", F.col("x").isNotNull() & F.col("y").isNotNull()),
        holds("feature dimension", F.col("features").isNull() | (F.size("features") == feat_dim)),
        holds("no NaN in features", F.col("features").isNull() | values),
    ]


def composed(*checks: Check | Iterable[Check]) -> list[Check]:
    """One list of checks and of lists of checks."""
    out: list[Check] = []
    for given in checks:
        out += [given] if isinstance(given, Check) else list(given)
    return out


def write_validated(df: DataFrame, path: str, checks: Sequence[Check], fail: bool = True) -> DataFrame:
    """Write a table and its report, one row per rule, in one pass over the rows; returns the report.

    The report is written last, and only if no rule is broken; ``fail`` decides whether a broken rule raises.
    """
    spark = df.sparkSession
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    metrics = [c.broken.cast("bigint").alias(f"m{k}") for k, c in enumerate(checks)]
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *metrics).write.mode("errorifexists").parquet(f"{path}/data")
    found = seen.get
    lines = [(c.rule, found[f"m{k}"], found["n_rows"]) for k, c in enumerate(checks)]
    report = spark.createDataFrame(lines, REPORT)
    broken = {rule: count for rule, count, _ in lines if count}
    if not broken:
        report.coalesce(1).write.mode("errorifexists").json(f"{path}/report")
    elif fail:
        raise ValidationError(f"{path} breaks {broken}")
    return report


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """A table that was published: fails where no report stands next to it."""
    spark.read.schema(REPORT).json(f"{path}/report").first()
    return spark.read.parquet(f"{path}/data")
