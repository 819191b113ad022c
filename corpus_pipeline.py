"""Corpus pipeline: documents to a clean, mixed, encoded corpus. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import Written, table
from quern.llm.exact_dedup import dedup_stage
from quern.llm.mixing import mixing_stage
from quern.llm.piece_codec import codec_stage
from quern.llm.shingle_join import shingle_stage
from quern.llm.toxicity import toxicity_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: (name, stage). All but the last return the columns of documents: toxic documents go; of equal texts the
#: row with the largest doc_id stays; of each class of near copies the smallest doc_id stays; the rows are put
#: in the order of the target weights; texts become piece ids, and position is the row's place in that order.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", dedup_stage),
    ("shingle_join", shingle_stage),
    ("mixing", mixing_stage),
    ("piece_codec", codec_stage),
]

#: The first stage is a trained network, which SQL can't express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), "stage").read()
    return STAGES[-1][1](spark, docs, sf_dir)
