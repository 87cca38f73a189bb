"""Streams of nodes: sources, rate limits, keyed deduplication, windows, sinks per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema: Any, *, format: str = "parquet", files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream; ``files_per_batch`` limits what a micro-batch admits."""
    r = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def throttled(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A clock stream of so many rows a second, to pace others by."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def deduplicated(df: DataFrame, key: str = "id", *, time: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first row of each key. With a time column the state is bounded: repeats count within that span of event time."""
    if time is None:
        return df.dropDuplicates([key])
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, size: str, *, late: str = "10 minutes", slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per window of event time: ``start, end, <by...>, n``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counted = df.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(df: DataFrame, time: str, gap: str, key: str, *, late: str = "10 minutes") -> DataFrame:
    """Rows per session of a key: a session ends after ``gap`` without rows."""
    counted = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def stored(df: DataFrame, store: Callable[[DataFrame, int], Any], checkpoint: str, *, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Gives each micro-batch to ``store`` with its number; a store by id makes a repeated batch harmless. ``once``: what is there now, then the stream ends."""
    w = df.writeStream.foreachBatch(lambda batch, n: store(batch, n) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drained(query: StreamingQuery) -> None:
    """Waits for a stream that ends by itself, and raises what it failed of."""
    query.awaitTermination()
    if (e := query.exception()) is not None:
        raise e
