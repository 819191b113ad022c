"""Window functions. Every one appends a column; ``order`` should be total, or the result depends on the input's order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spec(partition: Sequence[str] = (), order: Sequence = ()) -> WindowSpec:
    """Without a partition all rows share one window, and one task: give one wherever the data has it."""
    made = W.partitionBy(*partition)
    return made.orderBy(*order) if order else made


def _whole(partition: Sequence[str], order: Sequence) -> WindowSpec:
    return spec(partition, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _so_far(partition: Sequence[str], order: Sequence) -> WindowSpec:
    return spec(partition, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def ranking(df: DataFrame, function: str, partition: Sequence[str], order: Sequence, result: str = "window_result") -> DataFrame:
    """row_number, rank or dense_rank. Ranks without an order are all 1."""
    if not order and function != "row_number":
        return df.withColumn(result, F.lit(1).cast("long"))
    made = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[function]()
    return df.withColumn(result, made.over(spec(partition, order or [F.lit(1)])).cast("long"))


def running(df: DataFrame, function: str, column: str, partition: Sequence[str], order: Sequence, result: str = "window_result") -> DataFrame:
    """Running sum or average by row; null counts as 0. The average of whole numbers is cut towards zero."""
    frame = _so_far(partition, order)
    total = F.sum(F.coalesce(F.col(column), F.lit(0))).over(frame)
    made = total if function == "sum" else F.call_function("div", total, F.count("*").over(frame))
    return df.withColumn(result, made)


def rolling(df: DataFrame, function: str, column: str, partition: Sequence[str], order: Sequence, result: str = "rolling_result") -> DataFrame:
    """Expanding statistics by row: cumulative_sum, variance, stddev (of the sample; 0 for one row) or percentile.

    Variance is worked out in whole numbers and cut towards zero, so it is the same on every engine;
    percentile is the row's number among its partition's rows, in whole hundredths.
    """
    frame = _so_far(partition, order)
    x = F.coalesce(F.col(column), F.lit(0)).cast("decimal(19,0)")
    n = F.count("*").over(frame)
    if function == "cumulative_sum":
        made = F.sum(F.coalesce(F.col(column), F.lit(0))).over(frame)
    elif function in ("variance", "stddev"):
        s1, s2 = F.sum(x).over(frame), F.sum((x * x).cast("decimal(38,0)")).over(frame)
        spread = (n * s2 - s1 * s1).cast("decimal(38,0)")
        if function == "variance":
            made = F.when(n > 1, F.call_function("div", spread, (n * (n - 1)).cast("decimal(38,0)"))).otherwise(F.lit(0)).cast("long")
        else:
            made = F.when(n > 1, F.round(F.sqrt(spread.cast("double") / (n * (n - 1))), 6)).otherwise(F.lit(0.0))
    elif function == "percentile":
        place = F.row_number().over(spec(partition, order))
        made = F.call_function("div", place * F.lit(100), F.count("*").over(_whole(partition, [])))
    else:
        raise ValueError(f"no function {function}")
    return df.withColumn(result, made)


def offset(df: DataFrame, function: str, column: str, partition: Sequence[str], order: Sequence, n: int = 1, default=None, result: str = "ranking_result") -> DataFrame:
    """lag, lead, first_value or last_value of the whole partition; ``default`` also stands for null values."""
    value = F.col(column)
    made: Column
    if function == "lag":
        made = F.lag(value, n).over(spec(partition, order))
    elif function == "lead":
        made = F.lead(value, n).over(spec(partition, order))
    elif function == "first_value":
        made = F.first(value).over(_whole(partition, order))
    elif function == "last_value":
        made = F.last(value).over(_whole(partition, order))
    else:
        raise ValueError(f"no function {function}")
    return df.withColumn(result, made if default is None else F.coalesce(made, F.lit(default)))


def first_sum(df: DataFrame, column: str, partition: Sequence[str], order: Sequence, width: int, result: str = "window_total") -> DataFrame:
    """The sum of each partition's first ``width`` values, on every row."""
    place = F.row_number().over(spec(partition, order))
    total = F.sum(F.when(F.col("__place") <= width, F.coalesce(F.col(column), F.lit(0))).otherwise(0)).over(W.partitionBy(*partition))
    return df.withColumn("__place", place).withColumn(result, total).drop("__place")
