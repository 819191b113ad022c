"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Directory. The key of a text is its xxhash64, a bucket a prefix of keys. The directory starts at the depth that fits
the number of keys and doubles as long as a bucket holds more than ``capacity`` keys; only overfull buckets split, the
others keep their depth and several slots.

Owners. A task owns a range of directory slots and so a range of keys; texts are shuffled once, to their owner. There the
texts of a key are compared by their bytes: equal ones share a place in the key's chain, different ones have different
places. A key that many rows bear (more than ``hot_rows``) would be one owner's burden, so its rows are first united by bytes on
the map side: a text that a third of the corpus repeats costs its owner one row a united group, and its rows never move
with their texts.

Index. An entry for each place of a chain (bucket, depth, key, chain: the row that stays, the number of copies, the digest) is
written to the shared folder.

Probe. Every row knows its key and its place in the chain, looks its bucket up in the directory, and reads the entry there; rows of hot
keys find their place by digest among the key's few entries, or by bytes where two of these share a digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, table

KEY_BITS = 64
BUCKET_CAPACITY = 4096
HOT_ROWS, FILTER_BITS = 256, 22


def _prefix(key: Column, bits: int, key_bits: int) -> Column:
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(key, key_bits - bits)


def directory(entries: DataFrame, key_bits: int, capacity: int, owners: int = 1) -> list[tuple[int, DataFrame]]:
    """Levels of the directory: (depth, buckets (prefix, n)) whose buckets fit or can't split further.

    The driver sees one count a level, never keys. Levels partition the key space. There are at least four slots an owner.
    """
    total = entries.count()
    depth = min(key_bits, max(math.ceil(math.log2(max(1, total) * 2 / capacity)), math.ceil(math.log2(4 * owners))))
    levels, rest = [], entries.select("key")
    while True:
        buckets = rest.groupBy(_prefix(F.col("key"), depth, key_bits).alias("prefix")).agg(F.count("*").alias("n"))
        if depth == key_bits:
            return [*levels, (depth, buckets)]
        over = buckets.where(F.col("n") > capacity).select("prefix")
        if over.isEmpty():
            return [*levels, (depth, buckets)]
        levels.append((depth, buckets.where(F.col("n") <= capacity)))
        rest = rest.withColumn("prefix", _prefix(F.col("key"), depth, key_bits)).join(over, "prefix", "left_semi").select("key")
        depth += 1


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(text)
    if key_bits < 64:
        key = F.shiftrightunsigned(key, 64 - key_bits)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"))


def _cut(sha: Column, bits: int) -> Column:
    return sha if bits == 256 else F.substring(sha, 1, bits // 8)


def _owner(key: Column, depth: int, key_bits: int, owners: int) -> Column:
    """The task that owns a key: directory slots in order, dealt to ``owners`` ranges."""
    used = min(depth, 40)
    return F.shiftrightunsigned(_prefix(key, used, key_bits) * F.lit(owners).cast("long"), used).cast("int")


def _bucketed(rows: DataFrame, levels: list[tuple[int, DataFrame]], key_bits: int) -> DataFrame:
    """Rows with the bucket of their key: its depth and prefix, as the directory has them."""
    depth = levels[-1][0]
    own = F.lit(depth)
    for d, buckets in levels[:-1]:  # buckets that stopped splitting earlier share their slots
        found = buckets.select(F.col("prefix").alias(f"_p{d}"), F.lit(d).alias(f"_d{d}"))
        rows = rows.join(found, _prefix(F.col("key"), d, key_bits) == F.col(f"_p{d}"), "left").drop(f"_p{d}")
        own = F.coalesce(F.col(f"_d{d}"), own)
    rows = rows.withColumn("depth", own)
    prefix = _prefix(F.col("key"), depth, key_bits)
    for d, _ in levels[:-1]:
        prefix = F.when(F.col("depth") == d, _prefix(F.col("key"), d, key_bits)).otherwise(prefix)
    return rows.withColumn("bucket", prefix).drop(*[f"_d{d}" for d, _ in levels[:-1]])


def _bits(key: Column) -> tuple[Column, Column]:
    bit = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 64 - FILTER_BITS)
    return F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")


class Index:
    """The index of the texts of a table.

    ``levels``: the directory, (depth, buckets (prefix, n)). ``members``: a row for each text that its owner has seen, (id, key, depth, bucket, chain,
    sha, owner, hot), a hot one standing for many rows. ``entries``: (key, depth, bucket, chain, sha, keep_id, group_size).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS, digest_bits: int = 256, capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS):
        self.digest_bits = digest_bits
        self.rows = _keyed(docs, id_col, text_col, key_bits)
        self.spark = docs.sparkSession
        keys = Written(self.rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
        owners = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels = directory(keys.read().select("key"), key_bits, capacity, owners)
        word, at = _bits(F.col("key"))
        many = keys.read().where(F.col("n") > hot_rows)
        # A bit set of fixed size tells hot keys; a cold key that shares a bit goes the same way and comes to no harm.
        bits = many.select(word.alias("_word"), at.alias("_at")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_bits"))
        marked = self.rows.withColumn("_word", word).withColumn("_at", at).join(F.broadcast(bits), "_word", "left")
        self.marked = marked.withColumn("hot", F.expr("coalesce((shiftrightunsigned(_bits, _at) & 1) = 1, false)")).drop("_word", "_at", "_bits")
        self.has_hot = not many.isEmpty()
        united = self.marked.where("hot").groupBy("key", "text", "hot").agg(F.max("id").alias("id"), F.count("*").alias("n"))
        owned = self.marked.where("NOT hot").withColumn("n", F.lit(1).cast("long"))
        owned = owned.unionByName(united) if self.has_hot else owned
        owned = owned.withColumn("owner", _owner(F.col("key"), self.levels[-1][0], key_bits, owners)).repartitionById(owners, "owner")
        chain = F.dense_rank().over(W.partitionBy("owner", "key").orderBy("text"))
        seen = owned.withColumn("chain", chain).select("id", "key", "chain", "n", "hot", "owner", F.unhex(F.sha2("text", 256)).alias("sha"))
        self.members = Written(_bucketed(seen, self.levels, key_bits), "members").read()
        place = ["depth", "bucket", "key", "chain"]
        self.entries = Written(
            self.members.groupBy(*place).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.first("sha").alias("sha"), F.first("hot").alias("hot")), "index"
        ).read()

    def probe(self) -> DataFrame:
        """(id, keep_id, group_size, text_sha256) for every row, from the entries of the index."""
        entry = self.entries.select("depth", "bucket", "key", "chain", "keep_id", "group_size")
        cold = self.members.where("NOT hot").select("id", "depth", "bucket", "key", "chain", F.lower(F.hex("sha")).alias("text_sha256"))
        out = ["id", "keep_id", "group_size", "text_sha256"]
        found = cold.join(entry, ["depth", "bucket", "key", "chain"]).select(*out)
        if not self.has_hot:
            return found
        hot = self.entries.where("hot").select("key", "sha", "keep_id", "group_size").withColumn("sha", _cut(F.col("sha"), self.digest_bits))
        rows = self.marked.where("hot").select("id", "key", F.sha2("text", 256).alias("text_sha256")).withColumn("sha", _cut(F.unhex("text_sha256"), self.digest_bits))
        doubled = hot.groupBy("key", "sha").agg(F.count("*").alias("c")).where("c > 1").select("key", "sha")
        if doubled.isEmpty():
            return found.union(rows.join(hot, ["key", "sha"]).select(*out))
        # Different texts agree in key and digest: these rows find their place by their bytes.
        sole = hot.join(doubled, ["key", "sha"], "left_anti")
        rest = self.marked.where("hot").withColumn("sha", _cut(F.unhex(F.sha2("text", 256)), self.digest_bits)).join(doubled, ["key", "sha"], "left_semi")
        alike = self.marked.where("hot").join(doubled.select("key").distinct(), "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("c"))
        places = alike.withColumn("chain", F.dense_rank().over(W.partitionBy("key").orderBy("text"))).select("key", "text", "chain")
        by_bytes = rest.join(places, ["key", "text"]).join(entry, ["key", "chain"]).withColumn("text_sha256", F.sha2("text", 256))
        return found.union(rows.join(sole, ["key", "sha"]).select(*out)).union(by_bytes.select(*out))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS, digest_bits: int = 256, capacity: int = BUCKET_CAPACITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; an empty table gives no rows; other columns are ignored, whatever
    their names. Of equal texts the largest id stays. A null id is never kept while a copy has an id;
    rows that repeat both id and text are one document and are marked alike. ``key_bits``, ``digest_bits``, ``capacity`` and ``hot_rows`` are
    lowered only by tests, to force chains, equal digests, splits and hot keys.
    """
    found = Index(docs, id_col, text_col, key_bits, digest_bits, capacity, hot_rows).probe()
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` whose text is not repeated under a larger id; columns unchanged."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
