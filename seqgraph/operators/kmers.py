"""k-mer enumeration, counting and the solid filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import rc
from ..functions.stats import MAX_MULT, histogram
from . import packed
from .joins import shuffled

#: Longer sequences are cut into overlapping windows first, as a substring is found by walking from the start.
WINDOW = 1000


def windows(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """df with long sequences cut so that every substring of `size` is in exactly one piece; piece_at: where a piece begins."""
    n = F.length(seq)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - size), F.lit(WINDOW))
    cut = df.where(n >= size).select("*", F.explode(starts).alias("piece_at"))
    return cut.withColumn(seq, F.when(n <= WINDOW + size - 1, F.col(seq)).otherwise(F.substring(seq, F.col("piece_at") + 1, F.lit(WINDOW + size - 1))))


def enumerate_kmers(reads: DataFrame, size: int, seq: str = "seq", *keep: str) -> DataFrame:
    """(keep..., pos, kmer): every substring of `size`; shorter sequences have none."""
    cut = windows(reads.select(*keep, seq), size, seq)
    at = cut.select(*keep, seq, "piece_at", F.explode(F.sequence(F.lit(1), F.length(seq) - (size - 1))).alias("p"))
    return at.select(*keep, (F.col("piece_at") + F.col("p") - 1).alias("pos"), F.substring(seq, F.col("p"), F.lit(size)).alias("kmer"))


def beside(df: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """Like windows, but pieces have the base before and the one behind as well; lead: whether there's one before."""
    n = F.length(seq)
    cut = df.where(n >= size).select("*", F.explode(F.sequence(F.lit(0), n - size, F.lit(WINDOW))).alias("piece_at"))
    lead = F.least(F.lit(1), F.col("piece_at"))
    piece = F.substring(seq, F.col("piece_at") + 1 - lead, F.lit(WINDOW + size) + lead)
    return cut.withColumn(seq, F.when(n <= WINDOW + size - 1, F.col(seq)).otherwise(piece)).withColumn("lead", lead)


def _places(df: DataFrame, size: int, seq: str, *keep: str) -> DataFrame:
    """(keep..., s, r, p): a row for each place p (from 1) of a substring, with the sequence and its reverse complement.

    The reverse complement is taken once for a sequence, and what is made of a place is then compiled code, not a lambda.
    """
    both = df.where(F.length(seq) >= size).select(*keep, F.col(seq).alias("s"), rc(seq).alias("r"))
    return both.select("*", F.explode(F.sequence(F.lit(1), F.length("s") - (size - 1))).alias("p"))


def canonical_kmers(reads: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    """(edge): canonical substrings only, for counting."""
    df = _places(windows(reads.select(seq), size, seq), size, seq)
    return df.select(F.least(F.substring("s", F.col("p"), F.lit(size)), F.substring("r", F.length("s") - (size - 2) - F.col("p"), F.lit(size))).alias("edge"))


def with_neighbours(reads: DataFrame, size: int) -> DataFrame:
    """(read_id, pos, edge, strand, prev, next): canonical substrings with the bases beside them, swapped and complemented on strand 1; null at a read's ends."""
    n = F.length("s")
    df = _places(beside(reads.select("read_id", "seq"), size), size, "seq", "read_id", "piece_at", "lead").where((F.col("p") > F.col("lead")) & (F.col("p") <= F.col("lead") + WINDOW))
    df = df.withColumn("q", n - (size - 2) - F.col("p"))  # the same place on the other strand
    df = df.withColumns({"m": F.substring("s", F.col("p"), F.lit(size)), "t": F.substring("r", F.col("q"), F.lit(size))})
    side = lambda c, i: F.when((i >= 1) & (i <= n), F.substring(c, i, F.lit(1)))
    back = F.col("m") > F.col("t")
    return df.select(
        "read_id", (F.col("piece_at") - F.col("lead") + F.col("p") - 1).alias("pos"), F.least("m", "t").alias("edge"), back.cast("int").alias("strand"),
        F.when(back, side("r", F.col("q") - 1)).otherwise(side("s", F.col("p") - 1)).alias("prev"),
        F.when(back, side("r", F.col("q") + size)).otherwise(side("s", F.col("p") + size)).alias("next"),
    )


def count_edges(reads: DataFrame, k: int, seq: str = "seq", least: int = 1) -> DataFrame:
    """(edge, mult): canonical (k+1)-mers with their occurrences, 65535 at most; those that occur `least` times.

    Packed up to 31 bases, as strings beyond and in streams.
    """
    if packed.fits(k + 1) and not reads.isStreaming:
        return packed.counts(windows(reads.select(seq), k + 1, seq), k + 1, least, seq=seq)
    e = canonical_kmers(reads, k + 1, seq).groupBy("edge").agg(F.least(F.count("*"), F.lit(MAX_MULT)).cast("int").alias("mult"))
    return e.where(F.col("mult") >= least) if least > 1 else e


def count_codes(reads: DataFrame, k: int) -> DataFrame:
    """(code, mult): as count_edges, with the k-mers of 31 bases at most left packed, for reports that don't spell them."""
    return packed.counts(windows(reads.select("seq"), k + 1), k + 1, as_codes=True)


def solid_edges(reads: DataFrame, k: int, min_count: int = 2) -> DataFrame:
    return count_edges(reads, k, least=min_count)


def multiplicity_histogram(edges: DataFrame, with_zeros: bool = False) -> DataFrame:
    """(mult, n); with_zeros: a row for each of 1..65535."""
    h = histogram(edges, "mult").withColumnRenamed("value", "mult")
    if not with_zeros:
        return h
    every = edges.sparkSession.range(1, MAX_MULT + 1).select(F.col("id").cast("int").alias("mult"))
    return every.join(h, "mult", "left").select("mult", F.coalesce("n", F.lit(0)).alias("n"))


def edge_sides(reads: DataFrame, k: int, min_count: int = 2) -> DataFrame:
    """(edge, mult, has_in, has_out) of solid edges: some base before or after it occurs min_count times."""
    if packed.fits(k + 1, packed.SIDES) and not reads.isStreaming:
        return packed.sides(reads, k + 1, min_count)
    df = with_neighbours(reads, k + 1)
    sides = [F.count_if(F.col(c) == b).alias(f"{c}{b}") for c in ("prev", "next") for b in "ACGT"]
    g = df.groupBy("edge").agg(F.least(F.count("*"), F.lit(MAX_MULT)).cast("int").alias("mult"), *sides)
    most = lambda c: F.greatest(*[F.col(f"{c}{b}") for b in "ACGT"])
    return g.where(F.col("mult") >= min_count).select("edge", "mult", (most("prev") >= min_count).alias("has_in"), (most("next") >= min_count).alias("has_out"))


def read_tips(reads: DataFrame, k: int, min_count: int = 2) -> DataFrame:
    """(read_id, first_0_out, last_0_in): where solid edges without a way on begin, and without a way in end, in a read.

    On strand 0 an edge without an in side counts at its place for last_0_in, one without an out side at its place + 1
    for first_0_out; on strand 1 the roles swap. Null: there's none.
    """
    if packed.fits(k + 1, packed.SIDES) and not reads.isStreaming:
        occ, key, sides = packed.occurrences(reads, k + 1), "code", packed.sides(reads, k + 1, min_count, as_codes=True)
    else:
        occ, key, sides = with_neighbours(reads, k + 1).select("read_id", "pos", "edge", "strand"), "edge", edge_sides(reads, k, min_count)
    j = occ.join(shuffled(sides.where(~F.col("has_in") | ~F.col("has_out"))), key)
    s0 = F.col("strand") == 0
    last = F.when((s0 & ~F.col("has_in")) | (~s0 & ~F.col("has_out")), F.col("pos"))
    first = F.when((s0 & ~F.col("has_out")) | (~s0 & ~F.col("has_in")), F.col("pos") + 1)
    return j.groupBy("read_id").agg(F.min(first).alias("first_0_out"), F.max(last).alias("last_0_in"))


def mercy_candidates(reads: DataFrame, k: int, min_count: int = 2) -> DataFrame:
    """Reads whose last edge without a way in lies after the first without a way out."""
    return reads.join(shuffled(read_tips(reads, k, min_count).where("last_0_in > first_0_out").select("read_id")), "read_id", "left_semi")
