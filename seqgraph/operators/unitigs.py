"""Unitigs: maximal simple paths of the graph, and their refresh after cleaning.

A unitig row: uid (colex key of its first edge, the same in every run), seq, length (edges), total_depth, is_loop,
is_palindrome. Its reverse complement is the same unitig; the orientation with the lesser first key is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import colex, rc
from .graph import simple_links
from .joins import shuffled
from .paths import chains, cut_lineage, discard

COLUMNS = ["uid", "seq", "length", "total_depth", "is_loop", "is_palindrome", "is_changed"]


def depth() -> Column:
    return F.col("total_depth") / F.col("length")


def build(dbg: DataFrame, k: int, literal: bool = False) -> DataFrame:
    """Unitigs of a graph. literal: a loop's first edge counts twice in its depth."""
    dbg = cut_lineage(dbg)  # read three times
    edges = dbg.select(colex("edge").alias("id"), "edge", "mult")
    links = simple_links(dbg).select(colex("a").alias("a"), colex("b").alias("b"))
    placed = chains(edges.select("id"), cut_lineage(links)).join(shuffled(edges), "id")
    last = F.struct("rank", "edge", "mult")
    u = placed.groupBy("head", "is_loop").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.expr("right(edge, 1)").alias("b")))).alias("path"),  # one path's bases: its own result
        F.min(last).alias("first"), F.max(last).alias("last"), F.count("*").alias("length"), F.sum("mult").alias("total_depth"), F.min(colex(rc("edge"))).alias("least_rc"),
    )
    seq = F.concat(F.expr(f"left(first.edge, {k})"), F.array_join(F.col("path.b"), ""))
    own, twin = F.col("head"), F.when(F.col("is_loop"), F.col("least_rc")).otherwise(colex(rc("last.edge")))
    return u.where(own <= twin).select(
        own.alias("uid"), seq.alias("seq"), F.col("length").cast("long").alias("length"),
        (F.col("total_depth") + (F.when(F.col("is_loop"), F.col("first.mult")).otherwise(0) if literal else 0)).cast("long").alias("total_depth"),
        "is_loop", (own == twin).alias("is_palindrome"), F.lit(False).alias("is_changed"),
    )


def oriented(unitigs: DataFrame, k: int) -> DataFrame:
    """(uid, strand, oid, start, end, oseq, length, total_depth): linear unitigs both ways; start and end are nodes."""
    u = unitigs.where("NOT is_loop")
    both = u.select("*", F.explode(F.when(F.col("is_palindrome"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("strand"))
    both = both.withColumn("oseq", F.when(F.col("strand") == 0, F.col("seq")).otherwise(rc("seq")))
    return both.select("uid", "strand", F.concat_ws(":", "uid", "strand").alias("oid"), F.expr(f"left(oseq, {k})").alias("start"), F.expr(f"right(oseq, {k})").alias("end"), "oseq", "length", "total_depth", "is_palindrome")


def adjacency(unitigs: DataFrame, k: int) -> DataFrame:
    """(uid, strand, next_uid, next_strand, next_length, next_depth): what follows each oriented unitig; four at most."""
    o = oriented(unitigs, k)
    nxt = o.select(F.col("start").alias("end"), F.col("uid").alias("next_uid"), F.col("strand").alias("next_strand"), F.col("length").alias("next_length"), (F.col("total_depth") / F.col("length")).alias("next_depth"))
    return o.select("uid", "strand", "end").join(shuffled(nxt), "end").drop("end")


def ahead(unitigs: DataFrame, k: int, *totals: Column) -> DataFrame:
    """(uid, strand, totals...): what follows each oriented unitig, added up; none: no row. Totals are of oriented()'s columns and depth.

    They are those of the node that it ends at, so unitigs with a node in common aren't paired.
    """
    o = oriented(unitigs, k).withColumn("depth", depth())
    at = o.groupBy(F.col("start").alias("end")).agg(*totals)
    return o.select("uid", "strand", "end").join(shuffled(at), "end").drop("end")


def degrees(unitigs: DataFrame, k: int) -> DataFrame:
    """unitigs with outdeg (what follows) and indeg (what comes before) of the stored orientation; loops have none."""
    n = ahead(unitigs, k, F.count("*").alias("ways")).groupBy("uid").agg(*[F.coalesce(F.sum(F.when(F.col("strand") == i, F.col("ways"))), F.lit(0)).alias(c) for i, c in ((0, "outdeg"), (1, "indeg"))])
    pal = F.when(F.col("is_palindrome"), F.coalesce("outdeg", F.lit(0)))
    return unitigs.join(shuffled(n), "uid", "left").withColumn("indeg", F.coalesce(pal, "indeg", F.lit(0))).withColumn("outdeg", F.coalesce("outdeg", F.lit(0)))


def disconnect(unitigs: DataFrame, flagged: DataFrame, k: int) -> DataFrame:
    """Applies flags (uid, strand): one edge goes at the start of that orientation; the depth keeps its average.

    A unitig with no more edges than it loses is gone.
    """
    f = flagged.distinct().groupBy("uid").agg(F.max((F.col("strand") == 0).cast("int")).alias("head"), F.max((F.col("strand") == 1).cast("int")).alias("tail"))
    j = unitigs.join(shuffled(f), "uid", "left").withColumn("head", F.coalesce("head", F.lit(0))).withColumn("tail", F.coalesce("tail", F.lit(0)))
    j = j.withColumn("lost", F.col("head") + F.col("tail")).where(F.col("length") > F.col("lost"))
    depth_ = F.floor(F.col("total_depth") / F.col("length") * (F.col("length") - F.col("lost")) + 0.5).cast("long")
    seq = F.substring("seq", F.col("head") + 1, F.length("seq") - F.col("lost"))
    cut = F.col("lost") > 0
    j = j.select(
        F.when(cut, F.lit(None)).otherwise(F.col("uid")).alias("uid"), F.when(cut, seq).otherwise(F.col("seq")).alias("seq"), (F.col("length") - F.col("lost")).alias("length"),
        F.when(cut, depth_).otherwise(F.col("total_depth")).alias("total_depth"), "is_loop", "is_palindrome", (F.col("is_changed") | cut).alias("is_changed"),
    )
    return _named(j, k)


def _named(u: DataFrame, k: int) -> DataFrame:
    """uid from the sequence, in the orientation with the lesser first key."""
    first = lambda s: colex(F.expr(f"left({s}, {k + 1})"))
    u = u.withColumn("_r", rc("seq")).withColumn("_k0", first("seq")).withColumn("_k1", first("_r"))
    flip = ~F.col("is_loop") & (F.col("_k1") < F.col("_k0"))
    return u.select(F.when(flip, F.col("_k1")).otherwise(F.col("_k0")).alias("uid"), F.when(flip, F.col("_r")).otherwise(F.col("seq")).alias("seq"), *COLUMNS[2:5], (~F.col("is_loop") & (F.col("seq") == F.col("_r")) | (F.col("is_loop") & F.col("is_palindrome"))).alias("is_palindrome"), "is_changed")


def simple_joints(unitigs: DataFrame, k: int) -> DataFrame:
    """(a, b): oriented unitigs, by 2 * n + strand, where b alone follows a and a alone comes before b; no loops or palindromes.

    A node and its reverse complement have the same joints the other way round, so the lesser of the two stands for both.
    """
    ends = unitigs.where("NOT is_loop").select("n", "is_palindrome", F.expr(f"left(seq, {k})").alias("s"), F.expr(f"right(seq, {k})").alias("e"))
    ends = ends.withColumns({"rs": rc("s"), "re": rc("e")})
    at = lambda node, back, comes, strand: F.struct(F.col(node).alias("node"), F.col(back).alias("back"), F.lit(comes).alias("comes"), F.when(~F.col("is_palindrome"), 2 * F.col("n") + strand).alias("id"))
    twin = lambda *x: F.when(~F.col("is_palindrome"), at(*x))
    ports = ends.select(F.inline(F.array(at("e", "re", True, 0), at("s", "rs", False, 0), twin("rs", "s", True, 1), twin("re", "e", False, 1)))).where("node <= back")
    one = ports.groupBy("node").agg(F.count_if("comes").alias("i"), F.count_if(~F.col("comes")).alias("o"), F.max(F.when(F.col("comes"), F.col("id"))).alias("a"), F.max(F.when(~F.col("comes"), F.col("id"))).alias("b"))
    one = one.where("i = 1 AND o = 1 AND a IS NOT NULL AND b IS NOT NULL")
    turned = F.when(F.col("node") != rc("node"), F.struct(F.col("b").bitwiseXOR(F.lit(1)).alias("a"), F.col("a").bitwiseXOR(F.lit(1)).alias("b")))
    return one.select(F.inline(F.array(F.struct("a", "b"), turned))).where("a IS NOT NULL")


def refresh(unitigs: DataFrame, k: int, removed: DataFrame | None = None, mark_changed: bool = False) -> DataFrame:
    """Without the removed (uid), with unbranched chains of unitigs merged: lengths and depths add up, rings become loops.

    Chains are found on numbers, with sequences joined to them once. A chain and its reverse complement are told by the
    heads of a unitig's two strands; the one with the lesser head is spelled, and the other is made from it.
    """
    if removed is not None:
        unitigs = unitigs.join(shuffled(removed.select("uid").distinct()), "uid", "left_anti")
    name = F.when(F.col("uid") != F.col("seq"), F.col("uid")).alias("uid")  # null: the sequence is the name
    u = cut_lineage(unitigs.select(name, *COLUMNS[1:], F.monotonically_increasing_id().alias("n")))
    single = u.where("NOT is_loop AND NOT is_palindrome")
    nodes = single.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("strand"), "n", F.coalesce("uid", "seq").alias("uid"))
    chained = chains(nodes.select((2 * F.col("n") + F.col("strand")).alias("id"), F.concat_ws(":", "uid", "strand").alias("name")), simple_joints(u, k))
    of = lambda c, i: F.max(F.when(F.col("id") % 2 == i, F.col(c)))
    placed = chained.withColumn("n", F.expr("id div 2")).repartition("n").groupBy("n").agg(*[of(c, i).alias(f"{c}{i}") for c in ("head", "rank") for i in (0, 1)], F.max("is_loop").alias("is_loop"))
    placed = single.select("n", "seq", "length", "total_depth", "is_changed").join(shuffled(placed), "n")
    way = lambda i, s: F.struct(F.col(f"head{i}").alias("head"), F.col(f"rank{i}").alias("rank"), F.when(F.col(f"rank{i}") == 0, s).otherwise(F.substring(s, F.lit(k + 1), F.length(s))).alias("s"))
    ways = F.array(F.when(F.col("head0") <= F.col("head1"), way(0, F.col("seq"))), F.when(F.col("head1") <= F.col("head0"), way(1, rc("seq"))))
    parts = placed.select("length", "total_depth", "is_changed", "is_loop", (F.col("head0") == F.col("head1")).alias("own"), F.inline(ways)).where("head IS NOT NULL")
    g = parts.groupBy("head", "is_loop", "own").agg(
        F.sort_array(F.collect_list(F.struct("rank", "s"))).alias("path"), F.sum("length").alias("length"), F.sum("total_depth").alias("total_depth"), F.count("*").alias("n"), F.max("is_changed").alias("changed"),
    )
    g = g.withColumn("s", F.array_join(F.col("path.s"), "")).withColumn("first", F.col("path")[0]["s"]).withColumn("r", rc("s"))
    # A loop's other strand is cut before the same unitig.
    other = F.when(F.col("is_loop"), F.concat(rc("first"), F.substring("r", F.lit(k + 1), F.length("s") - F.length("first")))).otherwise(F.col("r"))
    key = lambda s: F.struct(colex(F.expr(f"left({s}, {k + 1})")).alias("uid"), F.col(s).alias("seq"))
    g = g.withColumn("t", other).withColumn("x", F.when(F.col("own"), key("s")).otherwise(F.least(key("s"), key("t"))))
    merged = g.select(
        "x.uid", "x.seq", "length", "total_depth", "is_loop", (~F.col("is_loop") & (F.col("s") == F.col("r"))).alias("is_palindrome"),
        (F.col("changed") | (F.lit(mark_changed) & (F.col("n") > 1))).alias("is_changed"),
    )
    done = cut_lineage(merged.unionByName(u.where("is_loop OR is_palindrome").select(F.coalesce("uid", "seq").alias("uid"), *COLUMNS[1:])))
    discard(chained, u)
    return done
