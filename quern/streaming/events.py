"""Streams of events: windows over event time with late data, sessions, duplicates. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream. Watermarks need times with a zone, so times without are read as the session's."""
    made = spark.readStream.schema(schema).parquet(folder)
    return made.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)})


def tumbling(events: DataFrame, time: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum of each window and key; rows later than ``late`` are left out of a stream."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size), *keys)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), *keys, "n", "total")
    )


def sliding(events: DataFrame, time: str, size: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, size, slide), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), *keys, "n")
    )


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
    )


def deduplicate(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
