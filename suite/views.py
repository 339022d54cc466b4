"""The same views as Spark DataFrames over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagstats.functions.probs import array_total, divided, once
from bagstats.functions.spread import TASK_ROWS, ranked, tasks_for
from bagstats.sources.shared import written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine's summation order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("slide_"), key).alias("slide_id"),
        F.concat(F.lit("slides/slide_"), key, F.lit(".SVS")).alias("filename"),
        F.col("o_custkey").cast("string").alias("group_id"),
        F.col("o_orderstatus").alias("label"),
        F.col("o_orderpriority").alias("site"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0)
    raised = F.col("value") + 20 * F.col("label")
    return (
        table(spark, sf, "events")
        .withColumn("label", label)
        .select(
            F.col("event_id").alias("slide_id"),
            F.col("user_id").alias("patient_id"),
            (F.col("event_id") % 5).cast("int").alias("fold"),
            "label",
            (raised / (raised + F.lit(50.0))).alias("prob_1"),
        )
    )


def predictions_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Ten classes: class c takes the sizes of components c, c + 10, c + 20, ... of all 64, over their total."""
    folded = []
    for c in range(10):
        parts = [F.abs(F.col("embedding")[i].cast("double")) for i in range(c, 64, 10)]
        folded.append(reduce(lambda a, b: a + b, parts))
    probs = once(F.array(*folded), lambda values: divided(values, array_total(values)))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("slide_id"), "label", probs.alias("probs"))


def patches(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Bags from line items, or some columns of them; the dense patch index comes from bucketed ranks, not from one window per slide,
    if a slide is more than a task should order.

    Rows alike in the first four columns of the order differ in their features alone: without these the others need not travel.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    if not columns or "features" in columns:
        order += ["l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("slide_id"), *order)
    sizes = rows.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    tasks = tasks_for(rows, sizes["n"] or 0)
    if (sizes["most"] or 0) > TASK_ROWS:
        placed = ranked(rows, ["slide_id"], [F.col(c) for c in order], [F.shiftright("l_orderkey", 16)], rank="place", tasks=tasks)
    else:
        placed = rows.repartition(tasks, "slide_id").withColumn("place", F.row_number().over(Window.partitionBy("slide_id").orderBy(*order)))
    made = {
        "slide_id": F.col("slide_id"),
        "patch_idx": (F.col("place") - 1).cast("int"),
        "x": ((F.col("l_partkey") % 64) * 256).cast("int"),
        "y": (F.col("l_quantity") * 256).cast("int"),
        "features": F.array(*[c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") if c in order]),
    }
    return placed.select(*[made[c].alias(c) for c in columns or made])


def stored_patches(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The same bags ranked and written once, for queries that read them several times."""
    return written(patches(spark, sf, *columns), "patches")


def embed_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Bags of 25 vectors each; the number of slides grows with the table."""
    idx = (F.col("vec_id") % 25).cast("int")
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 25").alias("slide_id"),
        idx.alias("patch_idx"),
        ((idx % 5) * 256).alias("x"),
        (F.floor(idx / 5) * 256).cast("int").alias("y"),
        F.col("embedding").alias("features"),
        "label",
    )


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("ms"))
