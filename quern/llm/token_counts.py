"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the driver, by putting every
piece through the merges. A pre-token (a part of the text that no merge crosses) found in that set
counts one at once; only the rest is merged. The set is as large as the vocabulary, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .common import ship, slices, table
from .piece_codec import default_model

LIMIT = 4096


class Counter(dict):
    """Tokens of a part: one for whole tokens, else by merging; remembered up to a bound."""

    def __init__(self, model: pieces.PieceModel, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.bound = model, len(whole) + pieces.CACHE_ENTRIES

    def __missing__(self, part: str) -> int:
        n = len(self.model.merge(part))
        if len(part) <= pieces.CACHE_CHARS and len(self) < self.bound:
            self[part] = n
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of ``docs``.

    Null and empty texts have no bytes and no tokens. Rows are independent: repeated rows, null ids
    and extra columns don't matter, an empty table gives no rows.
    """
    path = model or default_model()
    ship(docs.sparkSession)
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(pieces.load(path).whole())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.load(path)
        whole_set = whole.value
        tokens = Counter(model, whole_set)
        for batch in (part for all_rows in batches for part in slices(all_rows, "text")):
            if len(tokens) >= tokens.bound:
                tokens = Counter(model, whole_set)
            texts = batch.column("text")
            counts = [sum(map(tokens.__getitem__, model.split(t))) for t in texts.to_pylist()]
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = count_tokens(table(spark, sf_dir, "documents"))
    return made.withColumn("over_limit", F.col("n_tokens") > LIMIT)
