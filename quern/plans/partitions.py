"""Range, list and hash partitions: labels as derived columns, and predicates as sets of labels.

Spark prunes folders only by the partition column itself, so a predicate on the raw column is
accompanied by one on the label.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import compare
from ..sources.tables import shared_folder

LABEL = "p"


@dataclass(frozen=True)
class Ranges:
    """Inclusive ranges of whole numbers; the first that holds a value is its partition."""

    column: str
    parts: tuple[tuple[str, int, int], ...]

    def label(self) -> Column:
        made = F.lit(None).cast("string")
        for name, low, high in reversed(self.parts):
            made = F.when(F.col(self.column).between(low, high), F.lit(name)).otherwise(made)
        return made

    def labels(self) -> set[str]:
        return {p[0] for p in self.parts}

    def prune(self, column: str, op: str, value) -> set[str]:
        """Partitions that can hold a match."""
        if column != self.column or isinstance(value, bool) or not isinstance(value, int | float):
            return self.labels()
        test = {
            "=": lambda lo, hi: lo <= value <= hi,
            ">": lambda lo, hi: hi > value,
            ">=": lambda lo, hi: hi >= value,
            "<": lambda lo, hi: lo < value,
            "<=": lambda lo, hi: lo <= value,
        }.get(op, lambda lo, hi: True)
        return {name for name, lo, hi in self.parts if test(lo, hi)}


@dataclass(frozen=True)
class Lists:
    """Lists of values; the first list that holds a value is its partition."""

    column: str
    parts: tuple[tuple[str, tuple], ...]

    def label(self) -> Column:
        made = F.lit(None).cast("string")
        for name, values in reversed(self.parts):
            made = F.when(F.col(self.column).isin(*values), F.lit(name)).otherwise(made)
        return made

    def labels(self) -> set[str]:
        return {p[0] for p in self.parts}

    def prune(self, column: str, op: str, value) -> set[str]:
        if column != self.column or op != "=":
            return self.labels()
        return {name for name, values in self.parts if value in values}


@dataclass(frozen=True)
class Hashed:
    """A fixed number of buckets by hash."""

    column: str
    buckets: int

    def label(self) -> Column:
        return F.pmod(F.xxhash64(self.column), F.lit(self.buckets)).cast("string")

    def labels(self) -> set[str]:
        return {str(i) for i in range(self.buckets)}

    def label_of(self, value, kind: T.DataType) -> Column:
        """The label of a value of the column's type, as a constant that the planner folds before it prunes."""
        return F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(self.buckets)).cast("string")


Scheme = Ranges | Lists | Hashed


def write(df: DataFrame, scheme: Scheme, path: str) -> DataFrame:
    """Writes a folder for each partition; returns the rows that no partition takes."""
    labelled = df.withColumn(LABEL, scheme.label())
    labelled.where(F.col(LABEL).isNotNull()).write.partitionBy(LABEL).mode("overwrite").parquet(path)
    return labelled.where(F.col(LABEL).isNull()).drop(LABEL)


_STORED: dict[tuple, str] = {}


def stored(df: DataFrame, scheme: Scheme, name: str) -> DataFrame:
    """The table partitioned by ``scheme`` in the shared folder, written once a session; ``name`` tells tables apart. Rows without a partition are left out."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, name, scheme)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/quern-parts-{uuid.uuid4().hex}"
        write(df, scheme, path)
        _STORED[key] = path
    return spark.read.schema(df.schema.add(LABEL, "string")).parquet(_STORED[key])


def keep(scheme: Scheme, node: tuple) -> set[str]:
    """Labels for a predicate tree: and intersects, or unites, everything else keeps all."""
    if node[0] == "and":
        return keep(scheme, node[1]) & keep(scheme, node[2])
    if node[0] == "or":
        return keep(scheme, node[1]) | keep(scheme, node[2])
    if node[0] == "not" or isinstance(scheme, Hashed):
        return scheme.labels()
    return scheme.prune(*node)


def read_where(df: DataFrame, scheme: Scheme, column: str, op: str, value) -> DataFrame:
    """Matching rows of a partitioned table, reading only the folders that can hold any."""
    matches = compare(df, column, op, value)
    if isinstance(scheme, Hashed):
        return df.where(F.col(LABEL) == scheme.label_of(value, df.schema[column].dataType)).where(matches) if column == scheme.column and op == "=" else df.where(matches)
    return df.where(F.col(LABEL).isin(*sorted(scheme.prune(column, op, value)))).where(matches)


def bucketed(df: DataFrame, table: str, column: str, buckets: int, sort: Sequence[str] = ()) -> None:
    """A table bucketed by ``column``, so that joins and groups on it need no shuffle."""
    writer = df.write.bucketBy(buckets, column)
    (writer.sortBy(*sort) if sort else writer).mode("overwrite").saveAsTable(table)
