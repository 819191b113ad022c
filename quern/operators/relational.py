"""Filters, projections, joins, aggregates, sorting: lazy DataFrame plans with the engine's null and type rules.

Predicates are two-valued: a comparison with a missing value, or across types, is false (and so is its
part in NOT). Joins compare like types only; null keys match nothing unless asked for.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def _kind(value) -> type[T.DataType] | tuple:
    if isinstance(value, bool):
        return T.BooleanType
    if isinstance(value, int | float):
        return T.NumericType
    return T.StringType


def compare(df: DataFrame, column: str, op: str, value) -> Column:
    """``column op value``, for filters: not true where the column is absent, null or of another kind.

    A bare comparison, null for null, so that it reaches the scan; ``holds`` gives true and false only.
    """
    if op not in COMPARE:
        raise ValueError(f"no operator {op}")
    if column not in df.columns:
        return F.lit(False)
    if not isinstance(df.schema[column].dataType, _kind(value)):
        # Values of another kind differ from it, but have no order.
        return F.col(f"`{column}`").isNotNull() if op == "!=" else F.lit(False)
    return COMPARE[op](F.col(f"`{column}`"), F.lit(value))


def differs(df: DataFrame, column: str, op: str, value) -> Column:
    """Where ``compare`` is not true: the opposite comparison, or null."""
    if column not in df.columns:
        return F.lit(True)
    c = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, _kind(value)):
        return c.isNull() if op == "!=" else F.lit(True)
    return c.isNull() | compare(df, column, OPPOSITE[op], value)


def holds(condition: Column) -> Column:
    """True or false; false for null."""
    return F.coalesce(condition, F.lit(False))


def where(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(compare(df, column, op, value))


def tree(df: DataFrame, node: tuple, turned: bool = False) -> Column:
    """A predicate tree: ("and" | "or", left, right), ("not", part) or (column, op, value); for filters.

    NOT is carried down to the comparisons, where a null makes it true.
    """
    if node[0] in ("and", "or"):
        left, right = tree(df, node[1], turned), tree(df, node[2], turned)
        return left & right if (node[0] == "and") != turned else left | right
    if node[0] == "not":
        return tree(df, node[1], not turned)
    return differs(df, *node) if turned else compare(df, *node)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns, ``name`` or ``name:alias``; absent ones are left out."""
    parts = [c.split(":", 1) for c in columns]
    return df.select(*[F.col(f"`{p[0]}`").alias(p[-1]) for p in parts if p[0] in df.columns])


def project_padded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns; absent ones are null text."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def equi_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, strategy: str | None = None, null_safe: bool = False) -> DataFrame:
    """Inner join; columns that both have come from ``outer``. Keys of different kinds match nothing.

    ``strategy``: a join hint for the inner side (broadcast, shuffle_hash, merge); left to the planner by default.
    """
    ours, theirs = outer.schema[outer_key].dataType, inner.schema[inner_key].dataType
    same = type(ours) is type(theirs) or isinstance(ours, T.NumericType) and isinstance(theirs, T.NumericType)
    kept = [c for c in inner.columns if c not in outer.columns]
    right = inner.select(F.col(f"`{inner_key}`").alias("__key"), *[F.col(f"`{c}`") for c in kept])
    right = right.hint(strategy) if strategy else right
    left_key = F.col(f"`{outer_key}`")
    if not same:
        condition = F.lit(False)
    else:
        condition = left_key.eqNullSafe(F.col("__key")) if null_safe else left_key == F.col("__key")
    return outer.join(right, condition, "inner").drop("__key")


def semi_join(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows with a partner; also IN and EXISTS."""
    return df.join(other.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def anti_join(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def outer_join(left: DataFrame, right: DataFrame, key: str, how: str = "full") -> DataFrame:
    return left.join(right, key, how)


def aggregate(df: DataFrame, column: str, function: str, group: Sequence[str] = (), missing: str = "skip", result: str = "result") -> DataFrame:
    """One aggregate by group. ``missing``: "skip" as SQL does, or "zero": null counts as 0 and is counted.

    In zero mode an average of whole numbers is the sum divided by the number of rows, cut towards zero, and
    an empty input gives no row even without a group.
    """
    value = F.col(f"`{column}`")
    zero = missing == "zero"
    value = F.coalesce(value, F.lit(0)) if zero else value
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    if function == "avg":
        counted = F.count("*") if zero else F.count(value)
        if whole:
            made = F.call_function("div", F.sum(value), F.when(counted > 0, counted))
        else:
            made = F.sum(value) / F.when(counted > 0, counted)
    elif function == "count":
        made = F.count("*") if zero else F.count(value)
    else:
        made = {"sum": F.sum, "min": F.min, "max": F.max}[function](value)
    keys = [F.col(f"`{g}`") for g in group]
    if not keys and zero:
        return df.groupBy(F.lit(1).alias("__all")).agg(made.alias(result)).drop("__all")
    return df.groupBy(*keys).agg(made.alias(result))


def aggregate_many(df: DataFrame, column: str, group: Sequence[str], joined_key: str | None = None) -> DataFrame:
    """count, sum, min and max of the non-null values by several keys; optionally the keys as one text, '#' after each."""
    value = F.col(f"`{column}`")
    made = df.groupBy(*group).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    if joined_key:
        made = made.withColumn(joined_key, F.concat(*[F.concat(F.coalesce(F.col(g).cast("string"), F.lit("")), F.lit("#")) for g in group]))
    return made


def having(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return where(df, column, op, value)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row of each key, by ``order``."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", first).where("__row = 1").drop("__row")


def sort(df: DataFrame, column: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Ascending puts nulls first, descending last; ``tie`` makes the order total."""
    key = F.col(f"`{column}`")
    return df.orderBy(key.asc() if ascending else key.desc(), *tie)


def top(df: DataFrame, column: str, n: int, ascending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Sort and limit, planned as one bounded pass: each task keeps n rows."""
    return sort(df, column, ascending, tie).limit(n)


def group_top(df: DataFrame, group: Sequence[str], column: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The n largest rows of each group; the planner limits groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(column), *tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def point(df: DataFrame, key: str, value) -> DataFrame:
    """Lookup by key; the filter reaches the file statistics."""
    return df.where(F.col(key) == F.lit(value))


def key_range(df: DataFrame, key: str, first, last) -> DataFrame:
    """Keys between two values, both included, in key order."""
    return df.where(F.col(key).between(first, last)).orderBy(key)
