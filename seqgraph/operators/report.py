"""Reports on contigs and reads, and contig links as FASTG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import rc, rc_any_case
from ..functions.stats import histogram, nx, summary
from ..sources.fastx import ordinal
from .joins import shuffled


def n50(lengths: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: N50 (or Nx) of a column len, over the histogram of lengths."""
    return nx(histogram(lengths, "len"), share).withColumnRenamed("value", "n50")


def filter_by_length(contigs: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame]:
    """(contigs of min_len at least, one row: count, total, least, greatest, avg (integral), n50)."""
    kept = contigs.where(F.length("seq") >= min_len)
    h = histogram(kept.select(F.length("seq").alias("len")), "len")
    s = summary(h).select(F.col("n").alias("n_contigs"), "total", "least", "greatest", F.col("mean").alias("avg"))
    return kept, s.crossJoin(F.broadcast(nx(h).withColumnRenamed("value", "n50")))  # one row each


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: n, total, longest, shortest (999999999 without reads), avg."""
    n = F.length("seq")
    return reads.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.min(n), F.lit(999_999_999)).alias("shortest"), F.avg(n).alias("avg"))


def contig_stats(unitigs_with_degrees: DataFrame, k: int) -> DataFrame:
    """One row: greatest, least, total length (edges + k), n50, count, looped, isolated."""
    df = unitigs_with_degrees.withColumn("len", F.col("length") + k)
    s = df.agg(F.max("len").alias("greatest"), F.min("len").alias("least"), F.sum("len").alias("total"), F.count("*").alias("n_contigs"), F.count_if("is_loop").alias("n_looped"), F.count_if(~F.col("is_loop") & (F.col("indeg") + F.col("outdeg") == 0)).alias("n_isolated"))
    return s.crossJoin(F.broadcast(n50(df)))  # one row each


def contig_links(contigs: DataFrame, k: int) -> DataFrame:
    """(contig, strand, next_contig, next_strand): contigs of k + 1 bases at least whose ends overlap by k, either way round."""
    c = contigs.where(F.length("seq") >= k + 1).select("contig_id", F.upper("seq").alias("seq"))
    both = c.select("contig_id", F.inline(F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("strand"), rc("seq").alias("s")))))
    e = both.select("contig_id", "strand", F.expr(f"left(s, {k})").alias("start"), F.expr(f"right(s, {k})").alias("end"))
    return e.select(F.col("contig_id").alias("contig"), "strand", F.col("end").alias("at")).join(shuffled(e.select(F.col("start").alias("at"), F.col("contig_id").alias("next_contig"), F.col("strand").alias("next_strand"))), "at").drop("at")


def fastg(contigs: DataFrame, k: int, order: str | None = None) -> DataFrame:
    """(record) FASTG: NODE_i_length_L_cov_C_ID_{2i-1}, both strands, with their successors in order.

    i counts the contigs in their order: that of the file (place, if they come from one), else by id.
    """
    order = order or ("place" if "place" in contigs.columns else "contig_id")
    c = ordinal(contigs.where(F.length("seq") >= k + 1).select(F.col(order).alias("at"), "contig_id", "seq", "multi"), "at").withColumn("i", F.col("n") + 1)
    name = F.format_string("NODE_%d_length_%d_cov_%.4f_ID_%d", F.col("i"), F.length("seq"), F.col("multi"), 2 * F.col("i") - 1)
    named = c.select("contig_id", "i", name.alias("name"), "seq")
    ways = named.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("strand")).withColumn("s", F.when(F.col("strand") == 0, F.upper("seq")).otherwise(rc(F.upper("seq"))))
    ways = ways.withColumns({"start": F.expr(f"left(s, {k})"), "end": F.expr(f"right(s, {k})")})
    # What follows a contig is what begins at the node that it ends at: listed once for a node, not for each contig.
    t = F.struct("i", F.concat("name", F.when(F.col("strand") == 1, "'").otherwise("")).alias("t"))
    tail = ways.groupBy(F.col("start").alias("end")).agg(F.sort_array(F.collect_set(t)).alias("t"))
    j = ways.select("i", "strand", "name", "seq", "end").join(shuffled(tail), "end", "left")
    head = F.concat(F.lit(">"), "name", F.when(F.col("strand") == 1, "'").otherwise(""), F.when(F.size("t") > 0, F.concat(F.lit(":"), F.array_join(F.transform("t", lambda x: x["t"]), ","))).otherwise(""), F.lit(";"))
    return j.select("i", "strand", F.concat_ws("\n", head, F.when(F.col("strand") == 1, rc_any_case("seq")).otherwise(F.col("seq"))).alias("record"))


def write_fastg(contigs: DataFrame, path: str, k: int) -> None:
    fastg(contigs, k).select(F.col("record").alias("value")).write.mode("overwrite").text(path)
