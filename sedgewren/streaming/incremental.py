"""Incremental forms of the library's aggregates, for saves that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_rows(spark: SparkSession, folder: str, schema: str, files: int = 1000) -> DataFrame:
    """Parquet files of a folder as they arrive, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(rows: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Rows by window and key; windows close when the watermark, `late` behind the newest row, has passed them."""
    found = rows.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), key, "n")


def first_seen(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """One row a key among those that arrive within `late` of one another; older keys leave the state."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def running_saves(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Each key's first save and number of saves so far (update or complete mode). State grows with the keys."""
    return rows.groupBy(key).agg(F.min(ts).alias("first_saved"), F.count("*").alias("saves"))
