"""Windowed counts over event streams, and batches published once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need timestamps with a zone; local ones are read in the session's."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per key and window; rows later than the delay are dropped, so state stays bounded."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return _timed(events, time_col).withWatermark(time_col, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), *keys, "n")


def session_counts(events: DataFrame, time_col: str, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    return _timed(events, time_col).withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), *keys, "n")


def publish_batches(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Write each batch to its own folder by batch id: a batch that runs again replaces itself, so each is published once."""
    return stream.writeStream.foreachBatch(lambda df, batch: transform(df).write.mode("overwrite").parquet(f"{folder}/batch={batch}")).option("checkpointLocation", checkpoint)
