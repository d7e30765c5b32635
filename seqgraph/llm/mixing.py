"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Every source's documents, in the order of a hash of their id, are cut into blocks. Block j of a source of weight w is
released at slot floor((j-1)/w) and due by slot ceil(j/w); earliest-deadline-first over all slots gives each block its
slot, so that after any number of slots each source is less than one block from its share, as long as it has documents.
Weights are exact fractions of the targets: nothing is rounded and nothing repeats. One task works the slots out, block
after block, and writes them as it goes; it holds one block of each source. A source that runs out gives its slots up
and the others go on: no document is dropped or repeated, and slots that no block is released for stay empty.

A null source is a source of its own. Repeated rows keep a row each; ties in the hash go by id, then by a row's place
within its group. Null ids sort first. An empty table gives an empty result. Other columns ride along untouched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK, TEMPERATURE = 16, 2.0
MAX_SOURCES = 100_000


def slots_of(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block from 0, slot) of all blocks, in the order of slots, by earliest deadline first among released blocks.

    With weight w, block j (from 1) has release floor((j-1)/w) and deadline ceil(j/w), in whole numbers throughout. Ties
    in the deadline go to the block whose window overlaps the next one of its source, then to the heavier weight, then
    by name.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    if min(exact.values(), default=1) <= 0:
        raise ValueError("weights must be above 0")
    scale = math.lcm(*[x.denominator for x in exact.values()])
    heavy = {s: int(x * scale) for s, x in exact.items()}
    total = sum(heavy.values())

    def block(s, j: int) -> tuple:
        due, rest = divmod(j * total, heavy[s])
        return (j - 1) * total // heavy[s], due + (rest > 0), 1 if rest else 0

    waiting: list = []
    for s, n in blocks.items():
        if n:
            heapq.heappush(waiting, (0, str(s), s is None, 1, s))
    ready: list = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, name, none, j, s = heapq.heappop(waiting)
            _, due, overlap = block(s, j)
            heapq.heappush(ready, (due, -overlap, -heavy[s], name, none, j, s))
        due, _, _, name, none, j, s = heapq.heappop(ready)
        if due <= t:
            raise ValueError("a block misses its deadline")
        yield s, j - 1, t
        t += 1
        if j < blocks[s]:
            heapq.heappush(waiting, (block(s, j + 1)[0], name, none, j + 1, s))


def tempered(counts: dict, temperature: float = TEMPERATURE) -> dict:
    """Default targets: document counts to the power 1 / temperature."""
    return {s: max(1, n) ** (1 / temperature) for s, n in counts.items()}


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """docs with mix_block (from 1, within the source), mix_slot (from 0) and mix_place (within the block, from 0).

    Columns of docs that have these names are replaced. A document's rank in its source is its rank in a bucket of hashes
    plus the documents in lower buckets; buckets are so many that the largest source has a few thousand documents in
    each, so no task holds a source.
    """
    added = ("mix_block", "mix_slot", "mix_place")
    own = [f"doc.`{c}`" for c in docs.columns if c not in added]
    return _placed(docs, weights, block).select(*own, *[F.col(p).alias(c) for p, c in zip(("block", "slot", "place"), added)])


def in_order(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of docs, the same columns whatever their names, in the order of the mix: ranges of slots by task, sorted within."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(docs, weights, block).repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("doc.*")


def _placed(docs: DataFrame, weights: dict | None, block: int) -> DataFrame:
    """(doc, block, slot, place): a document is one column, so its own may have any names."""
    nothing = [F.lit(None).cast("long").alias(c) for c in ("block", "slot", "place")]
    counts = {r.s: r.n for r in docs.groupBy(F.col("source").cast("string").alias("s")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    if not counts:
        return docs.select(F.struct(*docs.columns).alias("doc"), *nothing)
    given = weights or tempered(counts)
    rest = min(given.values())
    targets = {s: given.get(s, rest) for s in counts}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    spark = docs.sparkSession
    buckets = 1 << max(0, (max(counts.values()) // 4096).bit_length())

    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").cast("string").alias("s"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).alias("h"))
    keyed = keyed.withColumn("b", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sizes = keyed.groupBy(F.col("s").alias("s2"), F.col("b").alias("b2")).agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("s2").orderBy("b2").rowsBetween(W.unboundedPreceding, -1))
    below = sizes.select("s2", "b2", F.coalesce(before, F.lit(0)).alias("below"), "c")

    def plan(batches):
        schema = pa.schema([("s4", pa.string()), ("j", pa.int64()), ("t", pa.int64())])
        for batch in batches:
            found = slots_of(targets, blocks) if batch.num_rows else iter(())
            while rows := list(islice(found, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    slot = written(spark.range(0, 1, 1, 1).mapInArrow(plan, "s4 string, j long, t long"), "slots")
    # Each bucket gets the slots of its own blocks, so documents are dealt out no more than for their ranks.
    spans = below.withColumn("j2", F.explode(F.expr(f"sequence(below div {block}, (below + c - 1) div {block})")))
    spans = spans.join(slot, F.col("s2").eqNullSafe(F.col("s4")) & (F.col("j2") == F.col("j")))
    spans = spans.groupBy("s2", "b2", "below").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("h", "i")) - 1)
    placed = ranked.join(spans, F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).withColumn("r", F.col("r") + F.col("below"))
    at = F.expr(f"ts[cast(r div {block} - below div {block} as int)]")
    return placed.select("doc", (F.expr(f"r div {block}") + 1).alias("block"), at.alias("slot"), F.pmod("r", F.lit(block)).cast("long").alias("place"))
