"""The two streaming jobs; both are append-only with a checkpointed file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bagstats.operators.scoring import Layer, classify


def stream_score(stream: DataFrame, head: Layer) -> DataFrame:
    """Class and probabilities of every arriving slide vector; row by row, without state."""
    return classify(stream, *head)


def stream_ingest_diff(stream: DataFrame, fingerprint: str, arrived: str | None = None, watermark: str | None = None) -> DataFrame:
    """Each slide once per encoder fingerprint.

    Without a watermark the state keeps every key ever seen.  With an arrival
    column and a watermark, keys are forgotten after that delay.
    """
    marked = stream.withColumn("fingerprint", F.lit(fingerprint))
    keys = ["slide_id", "fingerprint"]
    if arrived and watermark:
        return marked.withWatermark(arrived, watermark).dropDuplicatesWithinWatermark(keys)
    return marked.dropDuplicates(keys)


def run_available(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there now to a Parquet folder and stop."""
    return (
        out.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
