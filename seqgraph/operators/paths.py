"""Maximal chains by pointer doubling, with loops found and cut at their least member."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import shuffled


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again; survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what cut_lineage wrote for frames that nothing reads any more; only folders within the shared one."""
    for df in frames:
        spark = df.sparkSession
        shared = checkpoint_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(shared.split(":", 1)[-1].lstrip("/") + "/"):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _double(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, p, d, done): those that come to an end, (id, p, d), and those that never do. p moves towards the head, d counts steps.

    A round reads what is live: a row at its end that nothing points to now is written for the last time, as nothing
    will point to it later on; so a round's rows are those of the chains that are longer than its steps.
    """
    rows, over = rows.withColumn("live", F.lit(True)), []
    left = rows.where("NOT done").count()
    while left:
        b = rows.where("live")
        a = b.where("NOT done").select(F.col("id").alias("a"), F.col("p").alias("at"), F.col("d").alias("far"))
        moved = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("id"), "p", (F.col("d") + F.col("far")).alias("d"), "done", F.lit(True).alias("live")))
        ended = F.when(F.col("done"), F.struct("id", "p", "d", "done", F.col("a").isNotNull().alias("live")))
        nxt = cut_lineage(b.join(shuffled(a), F.col("id") == F.col("at"), "left").select(F.inline(F.array(moved, ended))).where("id IS NOT NULL"))
        rows = nxt
        over.append(rows)
        now = rows.where("NOT done").count()
        if now == left:
            break
        left = now
    done = rows.where("done")
    for r in over[:-1]:
        done = done.unionByName(r.where("NOT live"))
    return done.select("id", "p", "d"), rows.where("NOT done").select("id", "p")


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, head, rank, is_loop) for nodes (id) and one-to-one links (a, b).

    A chain's head has rank 0. A loop is cut before its least name, a column of nodes, or its least id if there's none.
    A round of doubling joins what isn't finished with itself by id; the number of rounds grows with the logarithm of
    the longest chain. Rounds are run on numbers: ids that are none are numbered first.
    """
    if dict(nodes.dtypes)["id"] == "bigint":
        return _chains(nodes if "name" in nodes.columns else nodes.select("id", F.col("id").alias("name")), links)
    at = cut_lineage(nodes.select("id", F.monotonically_increasing_id().alias("n")))
    number = lambda c, n: shuffled(at.select(F.col("id").alias(c), F.col("n").alias(n)))
    numbered = cut_lineage(links.join(number("a", "x"), "a").join(number("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = _chains(at.select(F.col("n").alias("id"), F.col("id").alias("name")), numbered).withColumnsRenamed({"id": "x", "head": "y"})
    return found.join(number("id", "x"), "x").join(number("head", "y"), "y").select("id", "head", "rank", "is_loop")


def _chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    none = F.col("prev").isNull()
    start = nodes.select("id").join(shuffled(links.select(F.col("b").alias("id"), F.col("a").alias("prev"))), "id", "left")
    start = cut_lineage(start.select("id", F.coalesce("prev", "id").alias("p"), F.when(none, 0).otherwise(1).cast("long").alias("d"), none.alias("done")))
    done, rest = _double(start)
    linear = done.select("id", F.col("p").alias("head"), F.col("d").alias("rank"), F.lit(False).alias("is_loop"))
    if rest.isEmpty():
        return linear
    start = rest.select("id").join(shuffled(start.select("id", F.col("p").alias("prev"))), "id").join(shuffled(nodes.select("id", "name")), "id")
    rings, old = start.select("id", F.col("prev").alias("p"), F.col("name").alias("mn")), None
    while True:  # every further doubling sees twice as much of a ring
        b = rings.select(F.col("id").alias("p"), F.col("p").alias("p2"), F.col("mn").alias("mn2"))
        nxt = cut_lineage(rings.join(shuffled(b), "p").select("id", F.col("p2").alias("p"), F.least("mn", "mn2").alias("mn"), (F.col("mn2") < F.col("mn")).alias("moved")))
        if old is not None:
            discard(old)
        rings = old = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    ring = rings.select("id", "mn").join(shuffled(start.select("id", "prev", "name")), "id")
    head = F.col("name") == F.col("mn")
    again, _ = _double(cut_lineage(ring.select("id", F.when(head, F.col("id")).otherwise(F.col("prev")).alias("p"), F.when(head, 0).otherwise(1).cast("long").alias("d"), head.alias("done"))))
    return linear.unionByName(again.select("id", F.col("p").alias("head"), F.col("d").alias("rank"), F.lit(True).alias("is_loop")))
