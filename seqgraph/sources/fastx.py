"""FASTA and FASTQ as DataFrames, and libraries of reads.

Files are read line by line by Spark's text source, which opens gzip and bzip2 itself, so a big plain file splits. In
one file, a line's order is its partition and offset; records are put together with a window per file over header
counts, kept apart by blocks of lines, or, for small files, by a whole-file split.
"""

from __future__ import annotations

import shutil
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seq import n_trim
from ..operators.joins import shuffled
from ..operators.paths import checkpoint_dir, cut_lineage

READ_COLUMNS = ["read_id", "lib_id", "mate", "seq", "len"]


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(record, place): the file cut at the separator; place orders the records of the file."""
    df = spark.read.option("lineSep", sep).text(path)
    return df.select(F.col("value").alias("record"), F.monotonically_increasing_id().alias("place"))


def _spooled(spark: SparkSession) -> str:
    """Standard input as a file in the shared folder."""
    with tempfile.NamedTemporaryFile() as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
        f.flush()
        path = f"{checkpoint_dir(spark)}/stdin-{uuid.uuid4().hex}.txt"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), p)
    return path


def _is_fastq(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("length(trim(value)) > 0").limit(1).collect()
    return bool(first) and first[0].value.startswith("@")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, comment, seq): the sequences of a FASTA file, multi-line or not, or of a FASTQ file of four lines a record.

    Plain, gzip or bzip2. Path "-": what standard input holds, by way of the shared folder. A FASTQ file of another form,
    or one with FASTA records among its own, is an error that names the record.
    """
    if path == "-":
        path = _spooled(spark)
    if _is_fastq(spark, path):
        return _scan_fastq(spark, path)
    df = _records(spark, path, "\n>")
    lines = F.split(F.regexp_replace("record", "\r", ""), "\n")
    head = F.regexp_replace(F.get(lines, F.lit(0)), "^>", "")
    seq = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))), ""), r"\s+", "")
    out = df.where("length(trim(record)) > 0").select("place", head.alias("head"), seq.alias("seq"))
    return out.select("place", *_name("head"), "seq")


def _scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ with four lines a record; qualities are not kept.

    A line's number is its rank in its partition plus the lines of the partitions before it, so no task sees the file.
    """
    df = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33))
    sizes = df.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row for each partition
    numbered = df.join(F.broadcast(before), "part").withColumn("line", F.col("b") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    line = lambda i: F.max(F.when(F.col("line") % 4 == i, F.regexp_replace("value", "\r", "")))
    rec = numbered.groupBy(F.expr("line div 4").alias("place")).agg(*[line(i).alias(c) for i, c in enumerate(("head", "seq", "plus", "quality"))])
    rec = rec.where("trim(concat_ws('', head, seq, plus, quality)) != ''")  # lines after the last record
    whole = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length(F.coalesce("quality", F.lit(""))))
    wrong = F.raise_error(F.concat(F.lit(f"{path}: not a FASTQ file of four lines a record, at record "), F.col("place").cast("string")))
    return rec.select("place", *_name(F.regexp_replace("head", "^@", "")), F.when(F.coalesce(whole, F.lit(False)), F.col("seq")).otherwise(wrong).alias("seq"))


def _name(head: Column | str) -> list[Column]:
    head = F.col(head) if isinstance(head, str) else head
    return [F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("comment")]


def encode(seq: Column | str) -> Column:
    """Upper case, the first run without N, every other letter as G; an empty sequence becomes one A."""
    s = F.regexp_replace(n_trim(seq), "[^ACGT]", "G")
    return F.when(F.length(s) == 0, F.lit("A")).otherwise(s)


def ordinal(df: DataFrame, order: str) -> DataFrame:
    """Adds n, from 0, in the order of a LONG column, without a task that sees all rows: rank in a range plus the ranges before it.

    The ranges are written once: sampled again, their bounds could differ between the two places that they're used in.
    """
    ranged = cut_lineage(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each range
    return ranged.join(F.broadcast(before), "_p").withColumn("n", F.col("_b") + F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1).drop("_p", "_b")


def single(spark: SparkSession, path: str) -> DataFrame:
    """(n, seq) of one file."""
    return ordinal(scan(spark, path), "place").select("n", encode("seq").alias("seq"))


def paired(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(n, seq) of two files in lockstep."""
    return interleaved(single(spark, first), single(spark, second))


def interleaved(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, seq) of two numbered lists: 2i from the first, 2i + 1 from the second, up to the end of the shorter."""
    both = a.join(shuffled(b.withColumnRenamed("seq", "mate_seq")), "n")
    return both.select(F.inline(F.array(F.struct((F.col("n") * 2).alias("n"), F.col("seq")), F.struct((F.col("n") * 2 + 1).alias("n"), F.col("mate_seq").alias("seq")))))


def build_library(spark: SparkSession, specs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(reads, libs) from specs ("pe", file1, file2), ("interleaved", file) or ("se", file), ids running on.

    An odd number of reads in a paired library is an error.
    """
    reads, begin, libs = None, 0, []
    for lib_id, (kind, *files) in enumerate(specs):
        if kind not in ("pe", "interleaved", "se"):
            raise ValueError(f"unknown library type {kind}")
        one = paired(spark, *files) if kind == "pe" else single(spark, files[0])
        size, longest, total = one.agg(F.count("*"), F.max(F.length("seq")), F.sum(F.length("seq"))).first()
        if kind != "se" and size % 2:
            raise ValueError(f"library {lib_id} is paired and has an odd number of reads")
        one = one.select((F.col("n") + begin).alias("read_id"), F.lit(lib_id).alias("lib_id"), (F.col("n") % 2 if kind != "se" else F.lit(0)).cast("int").alias("mate"), "seq", F.length("seq").alias("len"))
        reads = one if reads is None else reads.unionByName(one)
        libs.append((lib_id, begin, begin + size, longest or 0, kind != "se", " ".join([kind, *files]), total or 0))
        begin += size
    schema = "lib_id int, begin_id long, end_id long, max_read_len int, is_paired boolean, description string, n_bases long"
    if reads is None:
        reads = spark.createDataFrame([], "read_id long, lib_id int, mate int, seq string, len int")
    return reads, spark.createDataFrame(libs, schema)


def library_metadata(reads: DataFrame) -> DataFrame:
    """A row per library: first id, end id, longest read, reads and bases."""
    return reads.groupBy("lib_id").agg(F.min("read_id").alias("begin_id"), (F.max("read_id") + 1).alias("end_id"), F.max("len").alias("max_read_len"), F.count("*").alias("n_reads"), F.sum("len").alias("n_bases"))
