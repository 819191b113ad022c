"""Tables and files."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on one machine, where none is named, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-tables-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The table with ``values`` set in the rows that ``where`` holds for; write it to another path."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def ascii_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text; missing values show as null."""
    names, found = df.columns, df.limit(rows).collect()
    cells = [names, *[["null" if v is None else str(v) for v in r] for r in found]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|"
    return "\n".join([rule, line(names), rule, *[line(r) for r in cells[1:]], rule])


def demo_users(spark: SparkSession) -> DataFrame:
    """Twelve users."""
    region = F.when(F.col("id") % 2 == 0, "west").otherwise("east")
    return spark.range(12).select("id", region.alias("region"), region.alias("slot_region"), (F.col("id") * 7).alias("score"), (F.col("id") % 3).alias("group"))


def demo_events(spark: SparkSession) -> DataFrame:
    """Thirty-two events of the users."""
    i = F.col("id")
    return spark.range(32).select((i % 12).alias("id"), F.when(i % 4 == 0, "click").otherwise("view").alias("kind"), i.alias("score"), (i % 3).alias("group"))
