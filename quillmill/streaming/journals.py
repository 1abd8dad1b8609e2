"""Streaming forms of the journal operators, an extension: late rows, latest attempts, finished keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: str, time_col: str, lateness: str) -> DataFrame:
    """Rows of a growing folder of parquet files with a watermark on their time."""
    s = spark.readStream.schema(schema).parquet(folder)
    return s.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)


def latest_state(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of the largest order of each key so far, for update or complete mode (M2)."""
    row = F.struct(*(c for c in stream.columns if c != key))
    return stream.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("row")).select(key, "row.*")


def once_delivered(stream: DataFrame, key: str) -> DataFrame:
    """Rows of a key delivered again within the watermark count once (M1)."""
    return stream.dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time_col: str, width: str, *keys: str) -> DataFrame:
    """Rows in windows of time by key, given out when the watermark has passed."""
    return stream.groupBy(F.window(time_col, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feeds what is there in micro-batches to ``each`` and stops; a later call goes on from there (M7)."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
