"""From k to k + step: contig flanks, reads that run along them, and the longer edges that come out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seq import canonical, is_palindrome, rc
from ..functions.stats import MAX_MULT
from .joins import shuffled
from .kmers import enumerate_kmers

_FLIP = str.maketrans("ACGT", "TGCA")


def flanks(contigs: DataFrame, k: int, step: int) -> DataFrame:
    """(kmer, ext, mul): the first k + 1 bases of either end of a contig and up to step - 1 bases that follow.

    Palindromes are left out, a contig of k + 1 bases has one strand. Of several with the same k-mer the longest
    extension stays, then the one whose reversed extension is the greatest, with its multiplicity (ties: the greatest).
    """
    c = contigs.where(F.length("seq") >= k + 1)
    both = c.select("multi", F.explode(F.when(F.length("seq") == k + 1, F.array("seq")).otherwise(F.array(F.col("seq"), rc("seq")))).alias("s"))
    f = both.select(F.substring("s", 1, k + 1).alias("kmer"), F.substring("s", k + 2, step - 1).alias("ext"), F.col("multi").cast("double").alias("mul")).where(~is_palindrome("kmer"))
    best = F.max(F.struct(F.length("ext").alias("n"), F.reverse("ext").alias("r"), "mul")).alias("x")
    return f.groupBy("kmer").agg(best).select("kmer", F.reverse("x.r").alias("ext"), F.col("x.mul").alias("mul"))


def read_hits(reads: DataFrame, flank: DataFrame, k: int, step: int) -> DataFrame:
    """(read_id, pos, way, ext, mul): places of a read's k-mers in the flank index; way 1 is the reverse complement.

    Reads of k + step + 1 bases at least.
    """
    kmers = enumerate_kmers(reads.where(F.length("seq") >= k + step + 1), k + 1, "seq", "read_id")
    both = kmers.select("read_id", "pos", F.inline(F.array(F.struct(F.lit(0).alias("way"), F.col("kmer").alias("m")), F.struct(F.lit(1).alias("way"), rc("kmer").alias("m")))))
    return both.join(shuffled(flank.withColumnRenamed("kmer", "m")), "m").drop("m")


def covered(reads: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, mul): every place that a hit or its matching extension covers, whether or not it had to be probed.

    The relational form of the scan: hits times offsets, multiplicities averaged by place.
    """
    h = hits.join(shuffled(reads.select("read_id", "seq")), "read_id")
    here = F.when(F.col("way") == 0, F.substring("seq", F.col("pos") + k + 2, F.length("ext"))).otherwise(rc(F.expr("substring(seq, greatest(1, pos - length(ext) + 1), least(pos, length(ext)))")))
    n = F.least(F.length("ext"), F.length(here))
    same = F.size(F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(here, F.lit(1), i) == F.substring("ext", F.lit(1), i))) - 1
    h = h.withColumn("reach", same)
    far = h.select("read_id", "mul", F.explode(F.when(F.col("way") == 0, F.sequence(F.col("pos"), F.col("pos") + F.col("reach"))).otherwise(F.sequence(F.col("pos") - F.col("reach"), F.col("pos")))).alias("pos"))
    return far.groupBy("read_id", "pos").agg(F.avg("mul").alias("mul"))


def long_edges(reads: DataFrame, cover: DataFrame, k: int, step: int) -> DataFrame:
    """(edge, mult) of k + step + 1 bases wherever step + 1 places in a row are covered, with the mean rounded half up."""
    w = W.partitionBy("read_id").orderBy("pos").rowsBetween(-step, 0)
    runs = cover.withColumn("first", F.min("pos").over(w)).withColumn("n", F.count("*").over(w)).withColumn("m", F.avg("mul").over(w))
    runs = runs.where((F.col("n") == step + 1) & (F.col("pos") - F.col("first") == step))
    e = runs.join(shuffled(reads.select("read_id", "seq")), "read_id").select(canonical(F.substring("seq", F.col("first") + 1, F.lit(k + step + 1))).alias("edge"), F.least(F.lit(MAX_MULT), F.floor(F.round(F.col("m"), 6) + 0.5).cast("int")).alias("mult"))
    return e.groupBy("edge").agg(F.max("mult").alias("mult"))


def next_edges(reads: DataFrame, contigs: DataFrame, k: int, step: int, literal: bool = False) -> DataFrame:
    """Edges for k + step by the exact scan. literal: multiplicities are 0, as if none were kept in the index."""
    hits = read_hits(reads, flanks(contigs, k, step), k, step)
    out = long_edges(reads, scanned(reads, hits, k), k, step)
    return out.withColumn("mult", F.lit(0)) if literal else out


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def probed_intervals(seq: str, hits: list[tuple[int, int, str, float]], k: int) -> list[tuple[int, int, float]]:
    """(from, to, mul) of what a scan from left to right takes from a read's hits (pos, way, ext, mul), in its order.

    A hit covers its place and as many on, or back for the reverse complement, as its extension matches. Places that a
    hit on the forward way covers beyond its own aren't probed.
    """
    out, free = [], 0
    for pos, way, ext, mul in sorted(hits, key=lambda h: h[:2]):
        if pos < free and not (out and out[-1][0] == pos and way):
            continue  # covered, unless it's the other way of the place that has just been probed
        if way:
            back = seq[:pos][::-1].translate(_FLIP)
            out.append((pos - shared(ext, back), pos, mul))
        else:
            out.append((pos, pos + shared(ext, seq[pos + k + 1 :]), mul))
        free = max(free, out[-1][1] + 1)
    return out


def scanned(reads: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, mul): the places that the exact scan covers; of several multiplicities the running average of two in its order.

    Which hits are probed is found a read at a time, in Arrow batches (a read's hits are fewer than its places).
    """
    h = hits.groupBy("read_id").agg(F.collect_list(F.struct("pos", "way", "ext", "mul")).alias("hits")).join(shuffled(reads.select("read_id", "seq")), "read_id")

    def run(batches):
        schema = pa.schema([("read_id", pa.int64()), ("turn", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("mul", pa.float64())])
        for b in batches:
            rows = []
            for r, found, seq in zip(*(b.column(c).to_pylist() for c in ("read_id", "hits", "seq"))):
                taken = probed_intervals(seq, [(x["pos"], x["way"], x["ext"], x["mul"]) for x in found], k)
                rows += [(r, i, *x) for i, x in enumerate(taken)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    taken = h.mapInArrow(run, "read_id long, turn int, lo int, hi int, mul double")
    cover = taken.select("read_id", "turn", "mul", F.explode(F.sequence("lo", "hi")).alias("pos"))
    by_place = cover.groupBy("read_id", "pos").agg(F.array_sort(F.collect_list(F.struct("turn", "mul"))).alias("x"))
    average = F.aggregate(F.slice("x.mul", 2, F.greatest(F.lit(1), F.size("x"))), F.get("x.mul", F.lit(0)), lambda a, m: (a + m) / 2)
    return by_place.select("read_id", "pos", average.alias("mul"))
