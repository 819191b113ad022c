"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of rows. Block j of a source of weight a out of W may start at
floor((j - 1) W / a) and is due by ceil(j W / a); serving the earliest deadline among the released
blocks, one a slot, keeps every source less than one block from its share at any slot. Weights are
whole numbers, so the order repeats every W slots: one period is worked out on the driver, its size
bounded by the weights and not by the data, and every row finds its slot by arithmetic.

When a source runs out, the others go on at their weights among themselves: a new phase, with fresh
release times. There are as many phases as sources at most, and they follow from one count a source.
No row is dropped or repeated.

Ranks inside a source come without a sort of the source: rows are dealt to buckets by a hash, numbered
inside a bucket, and bucket counts are summed in two steps, so a source that holds a third of the rows
costs no task more than its share.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BLOCK_ROWS, BUCKET_ROWS = 64, 2048
OTHER = ""
#: Target weights of the query; sources that aren't named share the weight of OTHER.
WEIGHTS = {"src0": 20} | {f"src{i}": 6 for i in range(1, 10)} | {f"src{i}": 3 for i in range(10, 20)} | {OTHER: 1}
MADE = ["stream", "block", "phase", "release", "deadline", "slot", "position"]


def period(weights: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """(slot, release, deadline) of each block of one period, earliest deadline first; ties go by name."""
    whole = sum(weights.values())
    order: dict[str, list[tuple[int, int, int]]] = {s: [] for s in weights}
    waiting = [(0, s, 1) for s in sorted(weights)]  # (release, source, number of the block)
    ready: list[tuple[int, str, int, int]] = []
    heapq.heapify(waiting)
    for slot in range(whole):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * whole // weights[s]), s, j, release))
        due, s, j, release = heapq.heappop(ready)
        order[s].append((slot, release, due))
        if j < weights[s]:
            heapq.heappush(waiting, (j * whole // weights[s], s, j + 1))
    return order


def phases(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (phase, stream, first, past, base, whole, share) and (phase, stream, j, slot, release, deadline)."""
    left, done, base = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    spans: list[tuple] = []
    turns: list[tuple] = []
    phase = 0
    while left:
        active = {s: weights[s] for s in left}
        whole, order = sum(active.values()), period(active)
        end = min((n - 1) // active[s] * whole + order[s][(n - 1) % active[s]][0] + 1 for s, n in left.items())
        for s, n in list(left.items()):
            served = end // whole * active[s] + sum(slot < end % whole for slot, _, _ in order[s])
            if served:
                spans.append((phase, s, done[s], done[s] + served, base, whole, active[s]))
            done[s] += served
            left[s] = n - served
            if not left[s]:
                del left[s]
            turns += [(phase, s, j, *turn) for j, turn in enumerate(order[s])]
        base += end
        phase += 1
    return spans, turns


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    def text(v):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}L"

    listed = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, source_col: str = "source", order_by: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with stream, block, phase, release, deadline, slot and position.

    position orders the rows of the mix; block is the number of the row's block in its stream, release and
    deadline the slots between which the block is due, slot the one it gets. Inside a stream rows go by
    a hash of ``order_by`` (doc_id by default), then by its values; rows equal in all of them are
    interchangeable. Null and unnamed sources share the stream ''. Input columns that bear one of the made
    names are replaced. An empty table gives no rows. Weights are whole numbers of at least 1.
    """
    spark = docs.sparkSession
    weights = {OTHER: 1} | (weights or WEIGHTS)
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    order_by = order_by or ["doc_id"]
    named = [s for s in weights if s != OTHER]
    stream = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHER))
    names = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*names, stream.alias("stream"), F.xxhash64(*order_by).alias("_hash"))
    counts = {r["stream"]: r["count"] for r in docs.select(stream.alias("stream")).groupBy("stream").count().collect()}  # a row a weight at most
    total = sum(counts.values())
    if not total:
        empty = [F.lit(0).cast("long").alias(c) for c in MADE[1:]]
        return rows.drop("_hash").select(*names, "stream", *empty)
    bits = max(2, math.ceil(math.log2(max(1, total / BUCKET_ROWS))) + 2)
    low = bits // 2
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))

    # Rows before each bucket of a stream: sums of buckets inside a group of buckets, then of groups.
    held = rows.groupBy("stream", "_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.shiftright("_bucket", low))
    inside = W.partitionBy("stream", "_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("stream").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = held.groupBy("stream", "_group").agg(F.sum("_n").alias("_n")).select("stream", "_group", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_lead"))
    offsets = (
        held.select("stream", "_group", "_bucket", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_within"))
        .join(groups, ["stream", "_group"])
        .select("stream", "_bucket", (F.col("_lead") + F.col("_within")).alias("_before"))
    )
    place = F.row_number().over(W.partitionBy("stream", "_bucket").orderBy("_hash", *order_by)) - 1
    ranked = rows.withColumn("_place", place).join(offsets, ["stream", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    ranked = ranked.withColumn("block", F.expr(f"_rank DIV {block_rows}"))

    spans, turns = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    spans_ = F.broadcast(_values(spark, spans, "phase, stream, first, past, base, whole, share"))  # at most a row for each phase and weight
    turns_ = F.broadcast(_values(spark, turns, "phase, stream, turn, at, _release, _deadline"))  # at most the sum of weights a phase
    slotted = (
        ranked.join(spans_, "stream")
        .where("block >= first AND block < past")
        .withColumn("turn", F.expr("(block - first) % share"))
        .withColumn("_start", F.expr("base + (block - first) DIV share * whole"))
        .join(turns_, ["phase", "stream", "turn"])
    )
    return slotted.select(
        *names,
        "stream",
        "block",
        "phase",
        (F.col("_start") + F.col("_release")).alias("release"),
        (F.col("_start") + F.col("_deadline")).alias("deadline"),
        (F.col("_start") + F.col("at")).alias("slot"),
        F.expr(f"(_start + at) * {block_rows} + _rank % {block_rows}").alias("position"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: partitions are ranges of positions, sorted inside.

    Written, part files by number hold that order; codec_stage gives it back as position.
    """
    mixed = mix(docs).withColumnRenamed("position", "_position").select(*docs.columns, "_position")
    return mixed.repartitionByRange("_position").sortWithinPartitions("_position").select(*docs.columns)
