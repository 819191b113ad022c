"""Scalar functions of the expression language, as built-in expressions.

Whole numbers and text only: an argument of another kind gives the stated default.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def truthy(kind: str, value: Column) -> Column:
    """Whether a value of kind int, text, bool or none counts as true."""
    if kind == "bool":
        return F.coalesce(value, F.lit(False))
    if kind == "int":
        return F.coalesce(value != 0, F.lit(False))
    if kind == "text":
        return F.coalesce(F.octet_length(value) > 0, F.lit(False))
    return F.lit(False)


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def contains(text: Column, part: Column) -> Column:
    return F.coalesce(F.contains(text, part), F.lit(False))


def between(value: Column, low: Column, high: Column | None = None) -> Column:
    """Both ends included; without a high end, ten above the low one."""
    return F.coalesce(value.between(low, low + 10 if high is None else high), F.lit(False))


def bucket(value: Column, span: Column | None = None) -> Column:
    """Whole division by ``span`` (8), cut towards zero; a span of 0 counts as 1; null is bucket 0."""
    span = F.lit(8) if span is None else span
    span = F.when(span == 0, F.lit(1)).otherwise(span)
    return F.coalesce(F.call_function("div", value, span), F.lit(0).cast("long"))


def divide(left: Column, right: Column) -> Column:
    """Whole division, cut towards zero; by zero it gives 0."""
    return F.when(right == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", left, F.when(right != 0, right)))


def register(spark: SparkSession) -> None:
    """The functions for SQL text: q_len, q_contains, q_between, q_bucket."""
    for made in (
        "q_len(s STRING) RETURNS INT RETURN coalesce(octet_length(s), 0)",
        "q_contains(s STRING, part STRING) RETURNS BOOLEAN RETURN coalesce(contains(s, part), false)",
        "q_between(v BIGINT, low BIGINT, high BIGINT DEFAULT NULL) RETURNS BOOLEAN RETURN coalesce(v BETWEEN low AND coalesce(high, low + 10), false)",
        "q_bucket(v BIGINT, span BIGINT DEFAULT 8) RETURNS BIGINT RETURN coalesce(v DIV CASE WHEN span = 0 THEN 1 ELSE span END, 0)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}")
