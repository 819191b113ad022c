"""Operations planning as queries: checkpoint decisions, backup chains, replica placement, wait-for circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.reshape import recurse
from ..sources.tables import shared_folder


#: Pages that a light checkpoint writes at most, and that an incremental one may always write.
LIGHT_PAGES, INCREMENTAL_PAGES = 128, 256


def checkpoint_decisions(
    signals: DataFrame, min_interval: int = 30, wal_limit: int = 1000, dirty_limit: int = 100, lag_limit: int = 32, period: int = 300, full_every: int = 4, prefer_incremental: bool = True, during_backup: bool = True
) -> DataFrame:
    """What to do for each row of signals (shutdown, since_last, backup_requested, wal_records, dirty_pages, replica_lag, checkpoints_done).

    The first rule that holds decides: shutdown, too soon, backup, log, dirty pages, replica, period; since_last is null before the first
    checkpoint. Adds reason, mode (consistent, light, incremental, full, none) and flush_pages, how many dirty pages to write.
    Every ``full_every``-th checkpoint is full (0: none for that).
    """
    rule = (
        F.when(F.col("shutdown"), "shutdown")
        .when(F.col("since_last") < min_interval, "wait")
        .when(F.col("backup_requested") & F.lit(during_backup), "backup")
        .when(F.col("wal_records") >= wal_limit, "wal")
        .when(F.col("dirty_pages") >= dirty_limit, "dirty")
        .when(F.col("replica_lag") >= lag_limit, "replica")
        .when(F.col("since_last").isNull() | (F.col("since_last") >= period), "periodic")
        .otherwise("none")
    )
    done = F.col("checkpoints_done")
    due = (done > 0) & (done % full_every == 0) if full_every else F.lit(False)
    mode = (
        F.when(F.col("reason").isin("wait", "none"), "none")
        .when(due, "full")
        .when(F.col("reason").isin("shutdown", "backup"), "consistent")
        .when(F.col("reason") == "replica", "light")
        .when((F.col("reason") == "dirty") | F.lit(prefer_incremental), "incremental")
        .otherwise("full")
    )
    dirty = F.col("dirty_pages").cast("long")
    most = F.when(F.col("mode") == "none", 0).when(F.col("mode") == "light", LIGHT_PAGES).when(F.col("mode") == "incremental", max(INCREMENTAL_PAGES, dirty_limit // 2)).otherwise(dirty)
    return signals.withColumn("reason", rule).withColumn("mode", mode).withColumn("flush_pages", F.least(dirty, most))


def checkpoint_retention(checkpoints: DataFrame, keep_recent: int, min_age: int, now: int) -> DataFrame:
    """Checkpoints (id, at, mode, wal_start) with kept: the ``keep_recent`` latest (of equal times the larger id), the young, full and consistent ones.

    The latest are found as a top-k, so no task sorts all checkpoints; the log before the least wal_start of kept ones can go.
    """
    recent = checkpoints.select(F.col("at").alias("__at"), F.col("id").alias("__id")).orderBy(F.desc("__at"), F.desc("__id")).limit(keep_recent).select("__id", F.lit(True).alias("__recent"))
    kept = F.coalesce("__recent", F.lit(False)) | (F.col("at") + min_age > now) | F.col("mode").isin("full", "consistent")
    return checkpoints.join(recent, F.col("id") == F.col("__id"), "left").withColumn("kept", F.coalesce(kept, F.lit(False))).drop("__id", "__recent")


def reclaimable_log(retained: DataFrame) -> DataFrame:
    """The log position up to which nothing is needed: the least wal_start among kept checkpoints."""
    return retained.where("kept").agg(F.min("wal_start").alias("reclaimable"))


def backup_gaps(backups: DataFrame) -> DataFrame:
    """Backups (chain, id, parent, start_lsn, end_lsn) whose log range doesn't begin where the one before ended."""
    before = F.lag("end_lsn").over(W.partitionBy("chain").orderBy("start_lsn", "id"))
    return backups.withColumn("expected", before).where(F.col("expected").isNotNull() & (F.col("start_lsn") != F.col("expected")))


def restore_plan(spark: SparkSession, backups: DataFrame, target: str) -> DataFrame:
    """The chain from the full backup (no parent) to ``target``, oldest first; it has as many steps as there are backups at most."""
    known = backups.count()
    found = backups.where(F.col("id") == target).select("id", "parent", "start_lsn", "end_lsn", F.lit(0).alias("steps"))
    up = backups.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"), F.col("start_lsn").alias("__start"), F.col("end_lsn").alias("__end"))

    def parent(rows: DataFrame) -> DataFrame:
        held = rows.select(F.col("parent").alias("__child"), (F.col("steps") + 1).alias("steps"))
        return held.join(up, F.col("__child") == F.col("__id")).select(F.col("__id").alias("id"), F.col("__parent").alias("parent"), F.col("__start").alias("start_lsn"), F.col("__end").alias("end_lsn"), "steps")

    return recurse(found, parent, rounds=known).orderBy(F.desc("steps"))


def placement_issues(replicas: DataFrame, wanted: int = 2) -> DataFrame:
    """Shards (shard, node, online, leader) with too few replicas, two on a node, or not exactly one online leader."""
    per = replicas.groupBy("shard").agg(
        F.count("*").alias("replicas"),
        F.count_distinct("node").alias("nodes"),
        F.sum(F.when(F.col("leader") & F.col("online"), 1).otherwise(0)).alias("leaders"),
    )
    issue = F.when(F.col("nodes") < F.col("replicas"), "replicas share a node").when(F.col("replicas") < wanted, "too few replicas").when(F.col("leaders") != 1, "no single online leader")
    return per.withColumn("issue", issue).where(F.col("issue").isNotNull()).select("shard", "issue")


def failover(replicas: DataFrame, lag_limit: int = 32) -> DataFrame:
    """The new leader of each shard whose leader is offline: the online voter furthest in the log; safe if its lag is small.

    replicas: (shard, node, online, voter, leader, log_index).
    """
    ends = replicas.groupBy("shard").agg(F.max("log_index").alias("end"), F.bool_or(F.col("leader") & F.col("online")).alias("led"))
    best = W.partitionBy("shard").orderBy(F.desc("log_index"), "node")
    candidates = replicas.where("online AND voter").withColumn("place", F.row_number().over(best)).where("place = 1")
    return (
        candidates.join(ends.where("NOT led"), "shard")
        .select("shard", F.col("node").alias("new_leader"), (F.col("end") - F.col("log_index") <= lag_limit).alias("safe"))
    )


def wait_circles(spark: SparkSession, waits: DataFrame) -> DataFrame:
    """Transactions that wait for themselves through others, from rows (waiter, holder); circles of any length.

    Transactions that wait for nobody or hold nobody up are peeled off until none is left; what remains is closed by doubling: each round joins
    the distinct pairs with themselves, so circles of n take log n rounds. Rounds are checkpointed.
    """
    shared_folder(spark)
    core = waits.select("waiter", "holder").distinct().checkpoint()
    size = core.count()
    while size:
        core = core.join(core.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").join(core.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").select("waiter", "holder").checkpoint()
        was, size = size, core.count()
        if was == size:
            break
    reach = core
    while size:
        onward = reach.select(F.col("waiter").alias("holder"), F.col("holder").alias("__next"))
        reach = reach.union(reach.join(onward, "holder").select("waiter", F.col("__next").alias("holder"))).distinct().checkpoint()
        was, size = size, reach.count()
        if was == size:
            break
    return reach.where("waiter = holder").select(F.col("waiter").alias("tx"))


def kept_backups(backups: DataFrame, full: int = 2) -> DataFrame:
    """Backups (chain, id, parent, start_lsn, end_lsn) of the ``full`` latest chains, by the log position of their full backup."""
    heads = backups.where("parent IS NULL").select("chain", F.row_number().over(W.orderBy(F.desc("start_lsn"), "chain")).alias("__age"))
    return backups.join(heads.where(F.col("__age") <= full).select("chain"), "chain", "left_semi")


def rebalance(replicas: DataFrame) -> DataFrame:
    """(node, replicas, surplus): how many replicas each online node holds above an even share, rounded up; those with a surplus give some away."""
    held = replicas.where("online").groupBy("node").agg(F.count("*").alias("replicas"))
    share = held.agg(F.ceil(F.sum("replicas") / F.count("*")).alias("share")).scalar()
    return held.withColumn("surplus", F.greatest(F.lit(0).cast("long"), F.col("replicas") - share))
