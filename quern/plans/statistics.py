"""Column statistics, histograms and selectivity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ranges that are ranked apart.
SLICES = 64


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: rows, distinct values, nulls, least and greatest value as text.

    All columns in one pass; the distinct counts share one expansion.
    """
    made = []
    for c in columns:
        made += [F.count_distinct(c).alias(f"{c}__d"), F.count(c).alias(f"{c}__n"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi")]
    one = df.agg(F.count("*").alias("__rows"), *made)
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("__rows").alias("n_rows"),
            F.col(f"{c}__d").alias("n_distinct"),
            (F.col("__rows") - F.col(f"{c}__n")).alias("n_null"),
            F.col(f"{c}__lo").alias("least"),
            F.col(f"{c}__hi").alias("greatest"),
        )
        for c in columns
    ]
    return one.select(F.inline(F.array(*parts)))


def approximate_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Approximate distinct counts: a small sketch a task instead of a shuffle of the values."""
    return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])


def equi_width(df: DataFrame, column: str, low: float, high: float, buckets: int = 10) -> DataFrame:
    """Rows by bucket of equal width over [low, high]; the top end belongs to the last, values outside to none."""
    place = F.least(F.floor((F.col(column) - low) / ((high - low) / buckets)), F.lit(buckets - 1)).cast("long")
    return df.where(F.col(column).between(low, high)).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))


def equi_depth(df: DataFrame, column: str, buckets: int, tie: Sequence[str] = ()) -> DataFrame:
    """Least, greatest and number of values of each of ``buckets`` runs of like size, of a numeric column.

    Exact, and no task sees all values: equal values are counted first, sketched bounds cut the distinct values into SLICES ranges, ranges are
    ranked apart, and each range begins where the counts of those before it end. ``tie`` only orders equal values, which changes no bucket.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    bounds = values.agg(F.percentile_approx("__v", [i / SLICES for i in range(1, SLICES)], 10_000).alias("__bounds"))
    values = values.join(F.broadcast(bounds), F.lit(True))  # one row of SLICES - 1 bounds
    values = values.withColumn("__slice", F.size(F.filter("__bounds", lambda b: b < F.col("__v")))).drop("__bounds")
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)  # over SLICES rows
    slices = values.groupBy("__slice").agg(F.sum("__n").alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(F.lit(1))).alias("__all"))
    upto = W.partitionBy("__slice").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumn("__upto", F.sum("__n").over(upto)).join(F.broadcast(slices), "__slice")
    ranked = ranked.selectExpr("__v", "__before + __upto - __n AS __from", "__before + __upto - 1 AS __to", f"__all DIV {buckets} AS __q", f"__all % {buckets} AS __r")
    # The first r of the buckets hold one more than the others.
    bucket = "IF({0} < __r * (__q + 1), {0} DIV (__q + 1), __r + ({0} - __r * (__q + 1)) DIV greatest(__q, 1))"
    first = "IF(b < __r, b * (__q + 1), __r * (__q + 1) + (b - __r) * __q)"
    past = "IF(b + 1 < __r, (b + 1) * (__q + 1), __r * (__q + 1) + (b + 1 - __r) * __q)"
    parts = ranked.select("*", F.explode(F.expr(f"sequence({bucket.format('__from')}, {bucket.format('__to')})")).alias("b"))
    held = F.expr(f"least(__to + 1, {past}) - greatest(__from, {first})")
    return parts.groupBy((F.col("b") + 1).alias("bucket")).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.sum(held).alias("n"))


def equi_depth_bounds(df: DataFrame, column: str, buckets: int, accuracy: int = 10000) -> DataFrame:
    """Approximate upper bounds of the buckets by mergeable sketches, with no sort and no single task."""
    shares = [i / buckets for i in range(1, buckets + 1)]
    return df.agg(F.percentile_approx(column, shares, accuracy).alias("b")).select(F.posexplode("b").alias("bucket", "high"))


def width_selectivity(histogram: DataFrame, low: float, high: float, buckets: int, op: str, value: float) -> Column | float:
    """Estimated share of rows with ``column op value`` from an equi-width histogram (bucket, n)."""
    width = (high - low) / buckets
    total = F.sum("n")
    at = min(buckets - 1, max(0, int((value - low) / width)))
    inside = min(1.0, max(0.0, (value - low - at * width) / width))
    if op == "=":
        share = F.sum(F.when(F.col("bucket") == at, F.col("n") / width).otherwise(0)) / total
    else:
        below = F.sum(F.when(F.col("bucket") < at, F.col("n")).when(F.col("bucket") == at, F.col("n") * inside).otherwise(0.0)) / total
        share = below if op in ("<", "<=") else 1 - below
    return histogram.agg(share.alias("selectivity"))


def selectivity(n_distinct: int, low: float, high: float, op: str, value: float, default: float = 0.3) -> float:
    """Textbook estimate from one column's statistics: one in the distinct values, or the share of the range."""
    if op == "=":
        return 1.0 / n_distinct if n_distinct else default
    if high <= low:
        return default
    share = min(1.0, max(0.0, (value - low) / (high - low)))
    return share if op in ("<", "<=") else 1 - share if op in (">", ">=") else default


def combine(op: str, a: float, b: float) -> float:
    return a * b if op == "and" else a + b - a * b


def join_selectivity(left_distinct: int, right_distinct: int) -> float:
    return 1.0 / max(left_distinct, right_distinct, 1)


def bloom_size(expected: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) of a filter that lets ``rate`` of the absent values through at ``expected`` values."""
    bits = max(64, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / expected * math.log(2)))


def bloom_rate(bits: int, hashes: int, values: int) -> float:
    """The share of absent values that a filter holding ``values`` lets through, as estimated."""
    return (1 - math.exp(-hashes * values / bits)) ** hashes


def bloom_may_contain(df: DataFrame, column: str, probe: DataFrame, probe_column: str, expected: int, rate: float = 0.01) -> DataFrame:
    """Rows of ``probe`` whose value may occur in ``df``.

    The bits of ``df`` are one array of a size fixed by ``expected``, worked out once as a subquery; rows of ``probe`` are neither
    multiplied nor moved.
    """
    bits, hashes = bloom_size(expected, rate)
    place = lambda c, i: F.pmod(F.xxhash64(F.col(c), F.lit(i)), F.lit(bits))
    held = df.where(F.col(column).isNotNull()).select(F.explode(F.array(*[place(column, i) for i in range(hashes)])).alias("__bit"))
    words = held.select(F.expr("__bit DIV 64").alias("__word"), F.expr("shiftleft(1L, CAST(__bit % 64 AS INT))").alias("__bits"))
    every = df.sparkSession.range(-(-bits // 64)).select(F.col("id").alias("__word"), F.lit(0).cast("long").alias("__bits"))
    words = words.union(every).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    made = words.agg(F.expr("transform(array_sort(collect_list(struct(__word, __bits))), w -> w.__bits)")).scalar()
    seen = F.lit(True)
    for i in range(hashes):
        at = place(probe_column, i)
        word = F.get(made, F.call_function("div", at, F.lit(64)).cast("int"))
        seen = seen & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return probe.where(F.col(probe_column).isNotNull() & seen)


def dictionary_encode(df: DataFrame, column: str) -> DataFrame:
    """Codes of the distinct values in order; a null has none."""
    codes = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("code", (F.row_number().over(W.orderBy(column)) - 1).cast("long"))
    return df.join(codes, column, "left")


def delta_encode(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """The first value, then differences."""
    before = F.lag(column).over(W.partitionBy(*partition).orderBy(*order))
    return df.withColumn("delta", F.col(column) - F.coalesce(before, F.lit(0)))


def delta_decode(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    frame = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("value", F.sum("delta").over(frame))


def run_length(df: DataFrame, column: str, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Runs of equal values: (partition, run, value, n)."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy(*partition, "run").agg(F.first(column).alias("value"), F.count("*").alias("n"))


def dictionary_decode(coded: DataFrame, dictionary: DataFrame, code: str, value: str) -> DataFrame:
    """Values of codes, from the dictionary's rows (code, value); a null code is a null value."""
    return coded.join(dictionary.select(F.col("code").alias("__code"), F.col(value).alias(f"__{value}")).distinct(), F.col(code) == F.col("__code"), "left").drop("__code").withColumnRenamed(f"__{value}", "value")


def run_length_decode(runs: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """A row for each value of each run, numbered inside it: (partition, run, place, value)."""
    return runs.select(*partition, "run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place"), "value")


def encode(df: DataFrame, column: str, order: Sequence[str], how: str = "plain", partition: Sequence[str] = ()) -> tuple[str, DataFrame]:
    """(encoding used, rows encoded): plain, dictionary, delta or run_length. Delta is for whole numbers; other columns get a dictionary."""
    if how == "delta" and not isinstance(df.schema[column].dataType, T.IntegralType):
        how = "dictionary"
    if how == "plain":
        return how, df
    if how == "dictionary":
        return how, dictionary_encode(df, column)
    if how == "delta":
        return how, delta_encode(df, column, order, partition)
    if how == "run_length":
        return how, run_length(df, column, order, partition)
    raise ValueError(f"no encoding {how}")


def depth_selectivity(histogram: DataFrame, op: str, value: float) -> DataFrame:
    """Estimated share of rows with ``column op value`` from an equi-depth histogram (bucket, low, high, n), values spread evenly inside a bucket."""
    inside = F.when(F.col("high") > F.col("low"), (F.lit(float(value)) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.when(F.col("low") < value, 1.0).otherwise(0.0))
    below = F.sum(F.col("n") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside))) / F.sum("n")
    equal = F.sum(F.when((F.col("low") <= value) & (F.col("high") >= value), F.col("n") / (F.col("high") - F.col("low") + 1)).otherwise(0.0)) / F.sum("n")
    share = equal if op == "=" else 1 - equal if op == "!=" else below if op in ("<", "<=") else 1 - below
    return histogram.agg(share.alias("selectivity"))
