"""Parquet forms of reads, edges, graphs and contigs, FASTA contigs, and reads encoded from text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ, STEP = 100, 50
#: Substrings cut from a block of a long text.
BLOCK = 32
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
STANDALONE, LOOP = 1, 2


#: Bytes of a table that a task of the assembly operators gets: about four million k-mers.
SHARE = 1 << 21


def spread(df: DataFrame, share: int | None = None) -> DataFrame:
    """df over as many tasks as there are cores, if it has fewer: a table of one row group is read by one task otherwise.

    share: bytes of its files for a task at most, for steps that hold what they make of a task's rows.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if share:
        n = max(n, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // share)
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def text_to_dna(text: Column | str) -> Column:
    """Letters as bases in turn, everything else dropped: synthetic, to exercise the operators on text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGT]", "")


def cut(df: DataFrame, seq: str, n: Column, step: int, size: int, *keep: str) -> DataFrame:
    """(keep..., i, seq): n substrings of `size`, one every `step`; the last may be shorter.

    By way of blocks of them: a substring is found by walking from the start, which over a whole text takes the square of its length.
    """
    blocks = df.select(*keep, seq, n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))).alias("b"))
    blocks = blocks.select(*keep, "b", F.least(F.lit(BLOCK), F.col("n") - F.col("b") * BLOCK).alias("n"), F.substring(seq, F.col("b") * (BLOCK * step) + 1, F.lit((BLOCK - 1) * step + size)).alias("part"))
    at = blocks.select(*keep, "b", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return at.select(*keep, (F.col("b") * BLOCK + F.col("j")).alias("i"), F.substring("part", F.col("j") * step + 1, F.lit(size)).alias("seq"))


def reads_from_table(spark: SparkSession, sf_dir: str, table: str = "documents", id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """Reads of READ bases every `step` bases over the whole of every text; the last one may be shorter. id_col: SQL for a long id."""
    df = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"), SHARE).select(F.expr(id_col).cast("long").alias("id"), text_to_dna(text_col).alias("dna")).where("length(dna) > 0")
    n = F.greatest(F.lit(1), F.expr(f"(length(dna) - ({READ} - {step}) + {step} - 1) div {step}").cast("int"))
    df = cut(df, "dna", n, step, READ, "id")
    seq = F.col("seq")
    return df.select((F.col("id") * 1_000_000 + F.col("i")).alias("read_id"), F.lit(0).alias("lib_id"), (F.col("i") % 2).cast("int").alias("mate"), seq, F.length(seq).alias("len"))


def write_table(df: DataFrame, path: str) -> None:
    """Reads, edges or a graph as Parquet."""
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_contigs(records: DataFrame) -> DataFrame:
    """contigs from (name, comment, seq): flag, multi and k from headers like `>k21_0 flag=1 multi=2.0000 len=300`."""
    head = F.concat_ws(" ", "name", "comment")
    value = lambda key, kind: F.regexp_extract(head, rf"\b{key}=([0-9.]+)", 1).cast(kind)
    return records.select(
        F.col("name").alias("contig_id"),
        F.coalesce(F.expr("try_cast(regexp_extract(name, '^k([0-9]+)_', 1) AS int)"), F.lit(0)).alias("k"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(concat_ws(' ', name, comment), 'flag=([0-9]+)', 1) AS int)"), F.lit(0)).alias("flag"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(concat_ws(' ', name, comment), 'multi=([0-9.]+)', 1) AS double)"), F.lit(1.0)).alias("multi"),
        F.length("seq").alias("len"),
        F.upper("seq").alias("seq"),
    )


def scan_contigs(contigs: DataFrame, min_len: int = 0, discard_flag: int = 0, k_from: int = 0, k_to: int = 0) -> DataFrame:
    """Contigs of min_len at least and without the discarded flags; loops are extended from k_from to k_to.

    mult is the multiplicity as read for a graph: multi rounded half up.
    """
    df = contigs.where((F.col("len") >= min_len) & (F.col("flag").bitwiseAND(discard_flag) == 0))
    if k_to > k_from > 0:
        df = extend_loops(df, k_from, k_to)
    return df.withColumn("mult", F.least(F.lit(65_535), F.floor(F.col("multi") + 0.5).cast("int")))


def extend_loops(contigs: DataFrame, k_from: int, k_to: int) -> DataFrame:
    """Circular contigs with their bases [k_from, k_to) appended; loops shorter than k_to + 1 go."""
    loop = F.col("flag").bitwiseAND(LOOP) != 0
    seq = F.when(loop, F.concat("seq", F.substring("seq", k_from + 1, k_to - k_from))).otherwise(F.col("seq"))
    return contigs.where(~loop | (F.col("len") >= k_to + 1)).withColumn("seq", seq).withColumn("len", F.length("seq"))


def for_iterate(contigs: DataFrame) -> DataFrame:
    """Contigs that seed the next k: neither loops nor standalone."""
    return scan_contigs(contigs, discard_flag=LOOP | STANDALONE)


def header(k: int) -> Column:
    return F.format_string(f">k{k}_%s flag=%d multi=%.4f len=%d", F.col("contig_id"), F.col("flag"), F.col("multi"), F.col("len"))


def write_fasta(contigs: DataFrame, path: str, k: int) -> None:
    """Contigs as FASTA text."""
    contigs.select(F.concat_ws("\n", header(k), "seq").alias("value")).write.mode("overwrite").text(path)


def write_local_fasta(local: DataFrame, path: str) -> None:
    """Local contigs (origin_contig, strand, j, seq) as FASTA text."""
    local.select(F.concat_ws("\n", F.format_string(">lc_%s_strand_%d_id_%d flag=0 multi=1", F.col("origin_contig"), F.col("strand"), F.col("j")), "seq").alias("value")).write.mode("overwrite").text(path)


def contig_info(contigs: DataFrame) -> DataFrame:
    """Counts that go with a contig file: contigs and bases."""
    return contigs.agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_bases"))


def final_contigs(parts: list[DataFrame], last: DataFrame, min_len: int) -> DataFrame:
    """Standalone contigs of every k with the last k's contigs, of min_len at least."""
    out = last
    for p in parts:
        out = out.unionByName(p)
    return out.where(F.col("len") >= min_len)
