"""The corpus pipeline: every stage reads what the one before it wrote, and works on all of it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm import jaccard, mixing, pieces, secrets, toxicity
from seqgraph.llm.common import shared_dir
from seqgraph.llm.queries import model_path, table


#: Units that a task of the last stage remembers: its Python processes hold what the other stages used as well.
PIECE_MEMO = 300_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model, fitted on the labelled ones among docs, finds toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return jaccard.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into the order of the source mix; every document stays."""
    return mixing.in_order(docs)


def position(docs: DataFrame) -> Column:
    """A number that rises along the rows as they were written: number of the task, of its file, and row in the file.

    Spark packs splits of files by size when it reads them, so the order of reading isn't that of writing. Rows that
    come from no file have the order of their partitions.
    """
    if not docs.inputFiles():
        return F.monotonically_increasing_id()
    name = F.col("_metadata.file_name")
    task, file = (F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(task, 42) + F.shiftleft(file, 32) + F.col("_metadata.row_index")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, checked by decoding, in the order in which docs were written; position rises along it."""
    placed = docs.withColumn("position", position(docs))
    return pieces.encode_documents(placed, model_path("piece_bpe_32k.model"), keep=("source", "position"), order="position", memo=PIECE_MEMO)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
