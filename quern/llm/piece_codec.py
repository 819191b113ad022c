"""SentencePiece encoding and decoding of whole texts, in Arrow batches, with no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import ship, slices, table

MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_decode(docs: DataFrame, model: str | None = None, text_col: str = "text", keep: list[str] | None = None, ends: bool = True) -> DataFrame:
    """Columns ``keep`` (all by default) and ids, decoded, agreed.

    ids: little-endian unsigned 32-bit integers, with begin and end ids if ``ends``; decoded: the text
    that the ids stand for; agreed: the agenda gave the library's ids and text for every part (else the
    library's are returned). Null texts count as empty and give the end ids alone. Columns of ``docs``
    that bear one of the three names are replaced. Rows are independent: repeated rows, ties and extra
    columns don't matter, an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = model or default_model()
    made = ["ids", "decoded", "agreed"]
    keep = [c for c in (keep or docs.columns) if c not in made]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("ids"))  # the text travels under a made name
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()), T.StructField("agreed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.load(path)
        first = model.begin.to_bytes(4, "little") if ends else b""
        last = model.end.to_bytes(4, "little") if ends else b""
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            split = [model.split(t) for t in batch.column("ids").to_pylist()]
            known = model.look_up({p for parts in split for p in parts})
            ids, texts, agreed = [], [], []
            for parts in split:
                found = [known[p] for p in parts]
                ids.append(b"".join([first, *[x[0] for x in found], last]))
                texts.append(b"".join([x[1] for x in found])[1:])
                agreed.append(all(x[2] for x in found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(agreed, pa.bool_())],
                names=[*keep, *made],
            )

    return rows.mapInArrow(run, schema)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agreed",
    )


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with position, the place of a row in the files it is read from: parts by number, rows as written.

    A scan deals files to tasks by size, so the order of its rows is not that of the files. Only the
    number of rows of each file is gathered.
    """
    name = F.col("_metadata.file_name")
    number = lambda mark: F.regexp_extract(name, mark, 1).try_cast("long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = (
        docs.select(F.col("_metadata.file_path").alias("_file"), number(r"^part-(\d+)-").alias("_part"), number(r"-c(\d+)\.").alias("_piece"), F.col("_metadata.row_index").alias("_row"))
        .groupBy("_part", "_piece", "_file")
        .agg((F.max("_row") + 1).alias("_n"))
    )
    before = W.orderBy("_part", "_piece", "_file").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), "_file").select(*[c for c in docs.columns if c != "position"], (F.col("_before") + F.col("_row")).alias("position"))


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and the number of them; those read from files also with position, their order there."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # rows that come from no file have no order
        pass
    else:
        docs = _placed(docs)
    made = encode_decode(docs)
    return made.drop("decoded", "agreed").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
