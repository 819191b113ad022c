"""Near-duplicate embeddings by a pivot-permutation index.

Equal vectors of a label are united first. Each distinct vector is described by its nearest reference
points, in order: ``PREFIX`` of ``m`` unit vectors drawn from a seed, so nothing is fitted and every
executor draws the same ones. It enters the inverted lists of its ``LISTS`` nearest pivots. Inside a
list, pairs that share at least ``SHARED`` pivots of their prefixes are candidates; their cosine is
then taken in double precision. A pair is counted only in the first list that both are in, so lists
give sums of links for each vector and a spanning set of links, never the pairs themselves.

A list longer than ``BLOCK`` is split by a hash of the id into chunks, and every two chunks meet in
a task of their own: no group is capped and no group is held by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, components, ship, table

COSINE, PREFIX, LISTS, SHARED, BLOCK, SEED = 0.98, 8, 4, 3, 1536, 5


def pivots(count: int, dim: int, seed: int = SEED) -> np.ndarray:
    points = np.random.default_rng([seed, dim]).normal(size=(count, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def pivot_count(vectors: int) -> int:
    """Grows with the root of the input, so lists do as well; 4,096 points at most bound the matrix."""
    return int(min(4096, max(128, 2 * math.isqrt(vectors))))


def permutations(vectors: DataFrame, count: int, dims: str = "dim") -> DataFrame:
    """Adds perm: the numbers of the nearest pivots, nearest first."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("perm", T.ArrayType(T.IntegerType()))])
    names = vectors.columns

    def run(batches):
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(dims).to_numpy()
            found = np.empty((batch.num_rows, PREFIX), np.int32)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _matrix(batch.column("embedding").take(pa.array(at)), int(dim))
                if int(dim) not in drawn:
                    drawn[int(dim)] = pivots(count, int(dim)).T
                near = -(x @ drawn[int(dim)])
                top = np.argpartition(near, PREFIX, axis=1)[:, :PREFIX]
                value = np.take_along_axis(near, top, 1)
                found[at] = np.take_along_axis(top, np.lexsort((top, value)), 1)
            perm = pa.ListArray.from_arrays(np.arange(0, found.size + 1, PREFIX, dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], perm], names=[*names, "perm"])

    return vectors.mapInArrow(run, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(key: tuple, rows: pa.Table, cosine: float) -> pa.Table:
    """Links of two chunks of a list (or of one with itself): (u, links, v), v the least id that u's links reach here."""
    pivot, i, j = key[2].as_py(), key[3].as_py(), key[4].as_py()
    chunk = rows["c"].to_numpy()
    rows = rows.combine_chunks()
    ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
    x = _matrix(rows["embedding"].combine_chunks() if isinstance(rows["embedding"], pa.ChunkedArray) else rows["embedding"], key[1].as_py())
    perm = rows["perm"].combine_chunks().flatten().to_numpy().reshape(-1, PREFIX)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    # One-hot prefixes: products count shared pivots, and shared lists before this one.
    used, place = np.unique(perm, return_inverse=True)
    place = place.reshape(perm.shape)
    hot = np.zeros((len(ids), len(used)), np.float32)
    hot[np.arange(len(ids))[:, None], place] = 1
    early = np.zeros_like(hot)
    early[np.arange(len(ids))[:, None], place[:, :LISTS]] = perm[:, :LISTS] < pivot
    match = hot[left] @ hot[right].T >= SHARED
    match &= early[left] @ early[right].T == 0
    if i == j:
        np.fill_diagonal(match, False)
    a, b = np.nonzero(match)
    linked = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 17):
        part = slice(k, k + (1 << 17))
        linked[part] = np.einsum("nd,nd->n", x[left[a[part]]], x[right[b[part]]]) >= cosine
    a, b = left[a[linked]], right[b[linked]]
    if i != j:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    links = np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
    label = ids.copy()
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        if (least == label).all():
            break
        label = least
    some = links > 0
    return pa.table({"u": ids[some], "links": links[some], "v": label[some]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows with a null
    label or id, link with nothing. Equal vectors are linked, so a row that repeats another counts as
    another vector. Vectors of different length don't link. Other columns are ignored; an empty table
    gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    sound = F.expr(
        "id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    united = (
        rows.where("sound")
        .groupBy("label", "embedding")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding"))
    )
    reps = Written(united, "vectors").read()
    perms = Written(permutations(reps, pivot_count(reps.count())), "perms").read()
    posts = perms.withColumn("pivot", F.explode(F.slice("perm", 1, LISTS)))
    sizes = posts.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = (
        posts.join(sizes, ["label", "dim", "pivot"])
        .withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("i", F.least("c", "other"))
        .withColumn("j", F.greatest("c", "other"))
        .select("label", "dim", "pivot", "i", "j", "c", "rep", "copies", "embedding", "perm")
    )

    def run(key, rows):
        return _block(key, rows, cosine)

    found = Written(dealt.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(run, "u long, links long, v long"), "links").read()
    linked = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select("u", "v")).withColumnRenamed("node", "rep")
    described = reps.join(linked, "rep", "left").join(joined, "rep", "left").select(
        "label", "embedding", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "rep").alias("component")
    )
    whole = rows.where("sound").join(described, ["label", "embedding"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return whole.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")
    )


def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
