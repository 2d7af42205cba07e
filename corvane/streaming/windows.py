"""Counts of requests in fixed windows, over a table or over a stream of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def window_counts(events: DataFrame, width: str, limit: int, late: str | None = None) -> DataFrame:
    """(user_id, start, requests, limited) per client and window.

    Of a stream, `late` is how long rows may be late before their window is closed and its state dropped.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    g = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("user_id", F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("limited"))


def stream_of(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A stream over Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
