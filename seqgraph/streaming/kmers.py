"""k-mer counting over a growing folder of reads. An addition: batch counting is the operator, this keeps it up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import count_edges

READ_SCHEMA = "read_id long, lib_id int, mate int, seq string, len int"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Reads from Parquet files as they arrive."""
    return spark.readStream.schema(READ_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def edge_counts(reads: DataFrame, k: int) -> DataFrame:
    """(edge, mult) so far; the state is one count for each edge, as in batch."""
    return count_edges(reads, k)


def keep_counts(reads: DataFrame, k: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the edges that change in each micro-batch to a folder of its own under `out`; a batch run again replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edge_counts(reads, k).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """(edge, mult) as of the last batch that changed each edge."""
    df = spark.read.parquet(out)
    return df.groupBy("edge").agg(F.max_by("mult", "batch").alias("mult"))
