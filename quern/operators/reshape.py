"""Pivot, unpivot, set operations and recursion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def pivot(df: DataFrame, group: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Sums of ``value`` in a column for each of ``values``, 0 where there is none; groups without any stay.

    One aggregation with a conditional sum a value, so one shuffle of the groups.
    """
    sums = [F.coalesce(F.sum(F.when(F.col(column) == v, F.col(value))), F.lit(0)).alias(v) for v in values]
    return df.groupBy(*group).agg(*sums)


def unpivot(df: DataFrame, group: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A row for each named column that has a value; absent columns are left out."""
    present = [c for c in columns if c in df.columns]
    return df.unpivot([F.col(g) for g in group], [F.col(c) for c in present], name, value).where(F.col(value).isNotNull())


def recurse(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 50) -> DataFrame:
    """Union of the anchor, the step of the anchor, the step of that, and so on until nothing is left.

    At most ``rounds`` steps. Every round is checkpointed in the shared folder, so none is worked out twice. Where the
    step can be written in SQL, WITH RECURSIVE keeps the whole recursion in one plan; this form is for steps that are DataFrame code.
    """
    shared_folder(anchor.sparkSession)
    result = work = anchor.checkpoint()
    for _ in range(rounds):
        work = step(work).select(*anchor.columns).checkpoint()
        if work.isEmpty():
            break
        result = result.unionByName(work)
    return result


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made
