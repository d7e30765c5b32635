"""The de Bruijn graph as a table of directed edges, degrees and simple-path links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import rc
from ..functions.stats import MAX_MULT
from . import packed
from .joins import shuffled
from .kmers import solid_edges, windows, with_neighbours


def merge_sources(sources: list[DataFrame], k: int) -> DataFrame:
    """(edge, mult) from sequences (seq, mult) of several sources: an edge's multiplicity is the greatest.

    Sequences shorter than k + 1 have no edges.
    """
    every = None
    for s in sources:
        s = s.select("seq", F.col("mult").cast("int").alias("mult"))
        every = s if every is None else every.unionByName(s)
    cut = windows(every, k + 1)
    df = cut.select("mult", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k)).alias("p")).select("mult", F.substring("seq", F.col("p"), F.lit(k + 1)).alias("m"))
    return df.groupBy(F.least("m", rc("m")).alias("edge")).agg(F.least(F.max("mult"), F.lit(MAX_MULT)).alias("mult"))


def directed(edges: DataFrame) -> DataFrame:
    """dbg (src, dst, edge, edge_rc, mult): each canonical edge on both strands, a palindrome once."""
    e = edges.select(F.explode(F.array_distinct(F.array("edge", rc("edge")))).alias("edge"), "mult")
    return e.select(F.expr("left(edge, length(edge) - 1)").alias("src"), F.expr("right(edge, length(edge) - 1)").alias("dst"), "edge", rc("edge").alias("edge_rc"), "mult")


def from_reads(reads: DataFrame, k: int, min_count: int = 2, mercy: DataFrame | None = None) -> DataFrame:
    """One-pass graph: multiplicity counts the solid occurrences, and mercy edges where there are none."""
    e = solid_edges(reads, k, min_count)
    if mercy is not None:
        e = e.unionByName(only_in(mercy, e).groupBy("edge").agg(F.least(F.count("*"), F.lit(MAX_MULT)).cast("int").alias("mult")))
    return directed(e)


def flanked_counts(reads: DataFrame, k: int) -> DataFrame:
    """(edge, prev, next, mult): occurrences of an edge by the bases beside it."""
    if packed.fits(k + 1, packed.SIDES) and not reads.isStreaming:
        return packed.flanked(reads, k + 1)
    return with_neighbours(reads, k + 1).groupBy("edge", "prev", "next").agg(F.count("*").alias("mult"))


def degrees(dbg: DataFrame) -> DataFrame:
    """(node, indeg, outdeg)."""
    both = dbg.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return both.groupBy("node").agg(F.sum("i").cast("int").alias("indeg"), F.sum("o").cast("int").alias("outdeg"))


def adjacency(dbg: DataFrame) -> DataFrame:
    """(edge, next_edge): edges that follow one another; four at most on either side."""
    return dbg.select("edge", F.col("dst").alias("node")).join(shuffled(dbg.select(F.col("src").alias("node"), F.col("edge").alias("next_edge"))), "node").select("edge", "next_edge")


def simple_links(dbg: DataFrame) -> DataFrame:
    """(a, b): edges where b alone follows a and a alone comes before b."""
    through = degrees(dbg).where("indeg = 1 AND outdeg = 1").select("node")
    a, b = dbg.select(F.col("edge").alias("a"), F.col("dst").alias("node")), dbg.select(F.col("edge").alias("b"), F.col("src").alias("node"))
    return a.join(shuffled(through), "node").join(shuffled(b), "node").select("a", "b")


def symbol_counts(dbg: DataFrame) -> DataFrame:
    """Edges by their last base, with the number that is the last of its node and of dead ends."""
    d = degrees(dbg)
    w = dbg.join(shuffled(d.select(F.col("node").alias("dst"), "outdeg")), "dst")
    return w.groupBy(F.expr("right(edge, 1)").alias("symbol")).agg(F.count("*").alias("n"), F.count_if(F.col("outdeg") == 0).alias("n_dead_ends"))


def twins(dbg: DataFrame) -> DataFrame:
    """(edge, twin, mult): each directed edge with its reverse complement in the graph."""
    other = dbg.select(F.col("edge").alias("twin"), F.col("mult").alias("twin_mult"))
    return dbg.join(shuffled(other), F.col("edge_rc") == F.col("twin")).select("edge", "twin", F.col("twin_mult").alias("mult"))


def only_in(edges: DataFrame, others: DataFrame) -> DataFrame:
    """The edges that aren't among the others."""
    return edges.join(shuffled(others.select("edge")), "edge", "left_anti")
