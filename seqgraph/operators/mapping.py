"""Reads mapped to contigs by unique seeds, insert sizes, and the reads recruited to contig ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seq import canonical, mismatches, rc
from ..functions.stats import histogram, summary, trim
from .joins import shuffled
from .kmers import enumerate_kmers, windows


@dataclass(frozen=True)
class MapOptions:
    seed: int = 31
    sparsity: int = 8
    min_contig_len: int = 200
    min_read_len: int = 50
    min_mapped_len: int = 75
    similarity: float = 0.8
    max_range: int = 650


def seeds(contigs: DataFrame, opt: MapOptions = MapOptions()) -> DataFrame:
    """(kmer, contig_id, offset, cstrand): canonical seeds at every sparsity-th place; one that occurs twice is left out."""
    c = windows(contigs.where(F.length("seq") >= opt.min_contig_len).select("contig_id", "seq"), opt.seed)
    first = F.pmod(-F.col("piece_at"), F.lit(opt.sparsity))
    last = F.length("seq") - opt.seed
    at = c.where(first <= last).select("contig_id", "seq", "piece_at", F.explode(F.sequence(first, last, F.lit(opt.sparsity))).alias("o"))
    m = at.select("contig_id", (F.col("piece_at") + F.col("o")).alias("offset"), F.substring("seq", F.col("o") + 1, F.lit(opt.seed)).alias("m"))
    m = m.select(canonical("m").alias("kmer"), "contig_id", "offset", (F.col("m") > rc("m")).cast("int").alias("cstrand"))
    return m.groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.struct("contig_id", "offset", "cstrand")).alias("x")).where("n = 1").select("kmer", "x.*")


def candidates(reads: DataFrame, contigs: DataFrame, index: DataFrame, opt: MapOptions = MapOptions()) -> DataFrame:
    """Distinct projections of reads onto contigs, clipped to the contig; a clipped one needs min_mapped_len bases."""
    r = reads.where((F.length("seq") >= opt.seed) & (F.length("seq") >= opt.min_read_len)).select("read_id", F.length("seq").alias("rlen"), "seq")
    k = enumerate_kmers(r, opt.seed, "seq", "read_id", "rlen").withColumnRenamed("kmer", "m")
    k = k.select("read_id", "rlen", "pos", canonical("m").alias("kmer"), (F.col("m") > rc("m")).cast("int").alias("qstrand"))
    j = k.join(shuffled(index), "kmer").withColumn("strand", F.col("cstrand").bitwiseXOR(F.col("qstrand")))
    ahead = F.when(F.col("strand") == 0, F.col("pos")).otherwise(F.col("rlen") - opt.seed - F.col("pos"))  # bases before the seed, along the contig
    j = j.select("read_id", "rlen", "contig_id", "strand", (F.col("offset") - ahead).alias("raw_from")).distinct()
    lens = contigs.select("contig_id", F.length("seq").alias("clen"))
    j = j.join(shuffled(lens), "contig_id").withColumn("contig_from", F.greatest(F.lit(0), F.col("raw_from"))).withColumn("contig_to", F.least(F.col("clen") - 1, F.col("raw_from") + F.col("rlen") - 1))
    n = F.col("contig_to") - F.col("contig_from") + 1
    j = j.where((n >= F.col("rlen")) | (n >= opt.min_mapped_len)).withColumn("o", F.col("contig_from") - F.col("raw_from"))
    j = j.withColumn("query_from", F.when(F.col("strand") == 0, F.col("o")).otherwise(F.col("rlen") - F.col("o") - n)).withColumn("query_to", F.col("query_from") + n - 1)
    return j.select("read_id", "rlen", "contig_id", "clen", "contig_from", "contig_to", "query_from", "query_to", "strand").distinct()


def map_reads(reads: DataFrame, contigs: DataFrame, opt: MapOptions = MapOptions()) -> DataFrame:
    """mappings: for each read its best projection by matching bases, if no other has as many and enough match."""
    c = candidates(reads, contigs, seeds(contigs, opt), opt)
    j = c.join(shuffled(reads.select("read_id", "seq")), "read_id").join(shuffled(contigs.select("contig_id", F.col("seq").alias("cseq"))), "contig_id")
    n = F.col("query_to") - F.col("query_from") + 1
    q = F.substring("seq", F.col("query_from") + 1, n)
    j = j.withColumn("n", n).withColumn("mismatch", mismatches(F.when(F.col("strand") == 0, q).otherwise(rc(q)), F.substring("cseq", F.col("contig_from") + 1, n)))
    j = j.where(F.col("n") - F.col("mismatch") >= F.greatest(F.lit(1), F.floor(F.lit(opt.similarity) * F.col("n") + 0.5))).withColumn("match", F.col("n") - F.col("mismatch"))
    w = W.partitionBy("read_id")  # a read's projections
    j = j.withColumn("best", F.max("match").over(w)).withColumn("ties", F.count_if(F.col("match") == F.col("best")).over(w)).where("match = best AND ties = 1")
    return j.select("read_id", "contig_id", "contig_from", "contig_to", "query_from", "query_to", "mismatch", "strand", "rlen", "clen")


def pairs(mappings: DataFrame, reads: DataFrame, libs: DataFrame) -> DataFrame:
    """Mappings of both mates of a pair side by side: columns a_ and b_."""
    paired = libs.where("is_paired").select("lib_id", "begin_id")
    ids = reads.select("read_id", "lib_id").join(F.broadcast(paired), "lib_id").select("read_id", "lib_id", F.expr("(read_id - begin_id) div 2").alias("pair"), ((F.col("read_id") - F.col("begin_id")) % 2).alias("m"))  # a row for each library
    j = mappings.join(shuffled(ids), "read_id")
    a, b = (j.where(F.col("m") == i).select("lib_id", "pair", *[F.col(c).alias(f"{p}_{c}") for c in mappings.columns]) for i, p in ((0, "a"), (1, "b")))
    return a.join(shuffled(b), ["lib_id", "pair"])


def insert_sizes(mappings: DataFrame, reads: DataFrame, libs: DataFrame) -> DataFrame:
    """(lib_id, insert): mates on one contig in opposite directions, as far apart as either read is long."""
    p = pairs(mappings, reads, libs).where("a_contig_id = b_contig_id AND a_strand != b_strand")
    size = F.when(F.col("a_strand") == 0, F.col("b_contig_to") + F.col("b_rlen") - F.col("b_query_to") - (F.col("a_contig_from") - F.col("a_query_from"))).otherwise(F.col("a_contig_to") + F.col("a_rlen") - F.col("a_query_to") - (F.col("b_contig_from") - F.col("b_query_from")))
    return p.select("lib_id", size.alias("insert"), "a_rlen", "b_rlen").where("insert >= a_rlen AND insert >= b_rlen").select("lib_id", "insert")


def insert_stats(inserts: DataFrame, lib_id: int) -> tuple[float, float]:
    """(mean, sd) of a library's inserts without one in a hundred at the tails; -1, -1 without any."""
    r = summary(trim(histogram(inserts.where(F.col("lib_id") == lib_id), "insert"), 0.01)).first()
    return (float(r["mean"]), float(r["sd"])) if r and r["n"] else (-1.0, -1.0)


def local_range(libs: DataFrame, inserts: DataFrame, opt: MapOptions = MapOptions()) -> int:
    """Bases of a contig end that reads are recruited for: the most over all libraries (a row each, on the driver)."""
    most = 0
    for lib in libs.collect():
        r = lib.max_read_len - 1
        if lib.is_paired:
            mean, sd = insert_stats(inserts, lib.lib_id)
            if mean >= lib.max_read_len:
                r = int(min(2 * mean, mean + 3 * sd))
        most = max(most, min(r, opt.max_range))
    return most


def single_hits(mappings: DataFrame, range_: int) -> DataFrame:
    """local_hits of reads that hang over a contig's start (end 0) or end (end 1)."""
    start = (F.col("contig_to") < range_) & (F.col("query_from") != 0) & (F.col("query_to") == F.col("rlen") - 1)
    end = (F.col("contig_from") + range_ >= F.col("clen")) & (F.col("query_to") < F.col("rlen") - 1) & (F.col("query_from") == 0)
    e = F.when(start, 0).when(end, 1)
    return mappings.withColumn("end", e).where("end IS NOT NULL").select("contig_id", "end", F.when(F.col("end") == 0, F.col("contig_to")).otherwise(F.col("clen") - 1 - F.col("contig_from")).alias("offset"), F.lit(0).alias("is_mate"), "mismatch", "strand", "read_id")


def mate_hits(mappings: DataFrame, reads: DataFrame, libs: DataFrame, range_: int) -> DataFrame:
    """local_hits of mates that aren't on the anchor's contig: the anchor lies within range of an end and points out of it."""
    paired = libs.where("is_paired").select("lib_id", "begin_id")
    mate = reads.select("read_id", "lib_id").join(F.broadcast(paired), "lib_id").select("read_id", (F.col("begin_id") + (F.col("read_id") - F.col("begin_id")).bitwiseXOR(F.lit(1))).alias("mate_id"))  # a row for each library
    j = mappings.join(shuffled(mate), "read_id").join(shuffled(mappings.select(F.col("read_id").alias("mate_id"), F.col("contig_id").alias("mate_contig"))), "mate_id", "left").where("mate_contig IS NULL OR mate_contig != contig_id")
    e = F.when((F.col("contig_to") < range_) & (F.col("strand") == 1), 0).when((F.col("contig_from") + range_ >= F.col("clen")) & (F.col("strand") == 0), 1)
    return j.withColumn("end", e).where("end IS NOT NULL").select("contig_id", "end", F.when(F.col("end") == 0, F.col("contig_to")).otherwise(F.col("clen") - 1 - F.col("contig_from")).alias("offset"), F.lit(1).alias("is_mate"), "mismatch", "strand", F.col("mate_id").alias("read_id"))


def chosen_hits(hits: DataFrame, range_: int, max_read_len: int, per_place: int = 3) -> DataFrame:
    """Contig ends with more than range / longest read hits, with three reads at most for each offset and kind."""
    least = range_ // max_read_len if max_read_len else 1
    many = hits.groupBy("contig_id", "end").agg(F.count("*").alias("n")).where(F.col("n") > least).drop("n")
    w = W.partitionBy("contig_id", "end", "offset", "is_mate").orderBy("mismatch", "strand", "read_id")
    return hits.join(shuffled(many), ["contig_id", "end"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_place).drop("place")
