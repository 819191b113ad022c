"""Versions and logs as tables: snapshots, recovery, savepoints, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(versions: DataFrame, key: str, lsn: str, at: int | None, columns: list[str]) -> DataFrame:
    """The last version of each key at or before ``at``; None reads all, committed or not."""
    seen = versions if at is None else versions.where(F.col(lsn) <= at)
    last = F.max_by(F.struct(*columns), lsn)
    return seen.groupBy(key).agg(last.alias("v"), F.max(lsn).alias(lsn)).select(key, lsn, "v.*")


def visible_at(isolation: str, read_lsn: int) -> int | None:
    """The bound that an isolation level reads at."""
    return None if isolation == "read_uncommitted" else read_lsn


def recover(log: DataFrame, tx: str, key: str, lsn: str, committed: DataFrame, columns: list[str]) -> DataFrame:
    """State after a crash: the last write of each key among committed transactions."""
    winners = log.join(committed.select(tx), tx, "left_semi")
    return snapshot(winners, key, lsn, None, columns)


def losers(log: DataFrame, tx: str, ended: DataFrame) -> DataFrame:
    """Transactions without an end, whose writes are undone."""
    return log.select(tx).distinct().join(ended.select(tx), tx, "left_anti")


def rollback_to(log: DataFrame, tx: str, lsn: str, transaction: int, savepoint: int) -> DataFrame:
    """The log without what the transaction wrote after its savepoint."""
    return log.where((F.col(tx) != transaction) | (F.col(lsn) <= savepoint))


def recovery_start(dirty_pages: DataFrame, active: DataFrame, page_lsn: str, tx_lsn: str) -> DataFrame:
    """The least LSN that recovery has to read from."""
    return dirty_pages.select(F.col(page_lsn).alias("l")).union(active.select(F.col(tx_lsn).alias("l"))).agg(F.min("l").alias("start_lsn"))


def sequence_breaks(frames: DataFrame, order: str, sequence: str, stream: str | None = None) -> DataFrame:
    """Frames whose number doesn't follow the one before."""
    from pyspark.sql import Window as W

    before = F.lag(sequence).over(W.partitionBy(*([stream] if stream else [])).orderBy(order))
    return frames.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(sequence) <= F.col("before")))


#: Numbers of the frame types.
FRAME_TYPES = {"page": 1, "log": 2, "catalog": 3, "checkpoint": 4, "telemetry": 5, "payload": 6}


def missing_frame_types(frames: DataFrame, kind: str, required: list[str]) -> DataFrame:
    """The required types, by name, that no frame has; one partially aggregated row a type, whatever the number of frames."""
    held = [F.coalesce(F.bool_or(F.col(kind) == FRAME_TYPES[name]), F.lit(False)).alias(name) for name in required]
    named = F.array(*[F.struct(F.lit(name).alias("missing"), F.col(name).alias("held")) for name in required])
    return frames.agg(*held).select(F.explode(named).alias("t")).where("NOT t.held").select("t.missing")
