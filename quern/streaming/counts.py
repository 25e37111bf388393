"""Windowed counts, the same expression over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts by tumbling window and key; with `late`, rows may come that much out of order and state is dropped after it."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
