"""Helpers that several operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once an application, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():
        return  # the package is itself in a file that was sent
    made = f"{tempfile.mkdtemp(prefix='quern-code-')}/{root.name}.zip"  # on the driver, which serves it
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(made)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the session names none (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
            context.setCheckpointDir(found)
            _WRITTEN.append((spark, found))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def discard(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _WRITTEN:
        try:
            discard(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


class Written:
    """A table in the shared folder: cuts lineage, survives the loss of executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/quern-{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        _WRITTEN.append((self.spark, self.path))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def discard(self) -> None:
        discard(self.spark, self.path)
        _WRITTEN.remove((self.spark, self.path))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as rows (u, v), both long.

    Returns (node, component), component being the smallest node id that links reach; nodes without
    an edge have no row. Each round, all nodes of a label take the least label that any of them hears from a
    neighbour, and the label's own label: every class that borders a smaller one is absorbed, so rounds grow with the
    logarithm of the size. Every round is a table in the shared folder: nothing is gathered on the driver but
    whether a row changed. Labels are partially aggregated before each shuffle.
    """
    both = (
        edges.select("u", "v")
        .union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        .where("u <> v")
        .distinct()
    )
    both = Written(both, "edges")
    labels = Written(both.read().groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")), "labels")
    for _ in range(max_rounds):
        now = labels.read()
        heard = (
            both.read()
            .join(now.select(F.col("node").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        told = now.join(heard, "node")
        best = told.groupBy("component").agg(F.min("heard").alias("best"))
        jump = now.select(F.col("node").alias("component"), F.col("component").alias("jumped"))
        news = best.join(jump, "component", "left").select("component", F.least("best", F.coalesce("jumped", "best")).alias("news"))
        step = now.join(news, "component").select("node", F.col("component").alias("was"), F.least("component", "news").alias("component"))
        following = Written(step, "labels")
        changed = following.read().where("was <> component").limit(1).count()
        labels.discard()
        labels = following
        if not changed:
            break
    else:
        raise RuntimeError("labels still change; raise max_rounds")
    both.discard()
    return labels.read().select("node", "component")


def slices(batch, column: str, limit: int = 2_000_000):
    """Consecutive slices of an Arrow batch, each with about ``limit`` bytes of the text column or one row.

    Python objects made from a slice take many times its size, so batches are worked through in slices.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
