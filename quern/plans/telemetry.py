"""Metrics and traces as tables: counters, gauges, histograms, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Samples and total of each counter."""
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(value).alias("total"))


def gauges(samples: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The last value of each gauge; partially aggregated, with no sort."""
    return samples.groupBy(*keys).agg(F.max_by(value, order).alias("value"))


def histogram(samples: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Samples by the first bound that is at least the value (null: above all), and their sum. Not cumulative."""
    bound = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        bound = F.when(F.col(value) <= float(b), F.lit(float(b))).otherwise(bound)
    return samples.where(F.col(value).isNotNull()).groupBy(*keys, bound.alias("bound")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def merge_histograms(parts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made.groupBy(*keys, "bound").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def slow_spans(spans: DataFrame, threshold: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Ended spans that took at least ``threshold``; one that ends before it starts took 0."""
    made = spans.withColumn("duration", F.greatest(F.lit(0), F.col(end) - F.col(start)))
    return made.where((F.col(end) != 0) & (F.col("duration") >= threshold))


def report(samples: DataFrame, spans: DataFrame, threshold: int, since: int | None = None) -> DataFrame:
    """All metrics at once, as rows (section, name, n, value).

    samples (kind, name, value, at): counters give their total, gauges their last value by ``at``, observations their sum; other kinds are
    passed over. Spans (operation, start_ms, end_ms) that are slow give a row each with their duration. ``since`` is the time of the last
    reset: samples up to it, and spans that started up to it, are left out.
    """
    if since is not None:
        samples, spans = samples.where(F.col("at") > since), spans.where(F.col("start_ms") > since)
    value = F.when(F.col("kind") == "gauge", F.max_by("value", "at")).otherwise(F.sum("value")).cast("double")
    metrics = samples.where(F.col("kind").isin("counter", "gauge", "observe")).groupBy("kind", "name").agg(F.count("*").alias("n"), value.alias("value"))
    slow = slow_spans(spans, threshold).select(F.lit("slow_span").alias("section"), F.col("operation").alias("name"), F.lit(1).cast("long").alias("n"), F.col("duration").cast("double").alias("value"))
    return metrics.withColumnRenamed("kind", "section").unionByName(slow)


def parse(text: str) -> list[tuple[str, str, dict[str, str], float]]:
    """Lines ``kind|name|value|k=v,k=v`` (counter, gauge, observe); other lines are passed over."""
    out = []
    for line in text.splitlines():
        parts = [p.strip() for p in line.split("|")]
        if len(parts) >= 3 and parts[0] in ("counter", "gauge", "observe"):
            labels = dict(w.split("=", 1) for w in (parts[3].split(",") if len(parts) > 3 else []) if "=" in w)
            out.append((parts[0], parts[1], labels, float(parts[2])))
    return out
