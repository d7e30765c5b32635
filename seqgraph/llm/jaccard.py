"""N-gram Jaccard join on five-word shingles by chosen paths.

Every document's shingle set is embedded as a MinHash vector. In each of several runs a set walks down a tree: a node
picks which of the sampled tokens (vector places) to split on, and sets that share the token's value go on together.
Small nodes are compared by brute force. A larger one is split further where that saves comparisons, at several places
at once so that hardly a pair is lost; otherwise, or when its members share four tokens, it's compared block by block.
Runs are repeated until a pair at the threshold is met with the target probability even where its nodes are all split. What meets and looks alike is gathered into loose clusters, in which every pair's Jaccard
similarity is then worked out exactly on the full sets.

Sets that are equal are one class of copies from the start, with a count. A row of the result is a document: class_id
is the least doc_id of its connected class, n_links the number of other rows that its similarity reaches the threshold
with. Links are counted in blocks and never listed, so a group of m near copies makes m rows.

Null texts and texts without words have no shingles: no links, and themselves as class. Texts of fewer than five words
have one shingle, all their words. Repeated rows count as copies. Null ids: a class has the least id that isn't null; such rows have
links as others have.
An empty table gives an empty result. Other columns are not looked at. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, minhash, mix, shingles, slices, universal, written

THRESHOLD, SHINGLE, PLACES, SEED = 0.8, 5, 64, 8
#: Chance that a pair at the threshold meets in some run.
RECALL = 0.9999
#: Rows that a node may have to be compared by brute force, and sets and shingles that an exact block may hold.
NODE, BLOCK_SETS, BLOCK_SHINGLES = 2048, 1024, 400_000
#: Places that a large node is split at, each into children of its own, and how often it can be split. PLACES is a multiple of SPLIT.
SPLIT, SPLITS = 4, 2
#: A large node is split if that leaves less than this share of its comparisons.
GAIN = 1.0
#: Share of equal MinHash values from which two sets are held for candidates: more than four standard deviations below the threshold.
LOOSE = 37 / 64
#: A table of so many keys may be broadcast (16 bytes each).
BROADCAST_ROWS = 100_000
#: Words of 64 bits, and bits set for a key, of the Bloom filter that texts pass before they are shuffled: its only size.
SIEVE, SIEVE_BITS = 1 << 18, 3


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold is a candidate with probability recall, though all its nodes be split SPLITS times.

    A run takes one place, or two in one of four, at the root and at depth 1 (see paths), and SPLIT at each level below.
    The number of places at which the pair agrees is binomial; with too few of them (LOOSE) it's lost in any run.
    """
    agree = [(c / PLACES, math.comb(PLACES, c) * threshold**c * (1 - threshold) ** (PLACES - c)) for c in range(PLACES + 1)]
    lost = sum(p for q, p in agree if q < LOOSE)
    if lost >= 1 - recall:
        raise ValueError(f"{PLACES} places are too few for a recall of {recall} at {threshold}")

    def missed(q: float) -> float:
        second = q * (0.75 * q + 0.25 * (1 - (1 - q) ** 2)) * (1 - (1 - q) ** SPLIT) ** SPLITS
        return 1 - (0.75 * second + 0.25 * (1 - (1 - second) ** 2))

    runs = 1
    while lost + sum(p * missed(q) ** runs for q, p in agree if q >= LOOSE) > 1 - recall:
        runs += 1
    return runs


def paths(sig: np.ndarray, runs: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For a matrix of MinHash vectors: (rows, [their nodes at depth 2]) for each chosen path.

    Places are chosen by the node, so all sets in a node agree on them. The root takes one place, in every fourth run
    two; a node at depth 1 takes one, one node in four two.
    """
    n, width = sig.shape
    rows = np.arange(n)
    sig = sig.astype(np.uint64)

    def step(node: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(node * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) << np.uint64(32)) + sig[at, place])

    for r in range(runs):
        for branch in range(2 if r % 4 == 0 else 1):
            root = np.full(n, (r * 2 + branch + 1) * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
            first = int(mix(root[:1].copy())[0] % np.uint64(width)) if n else 0
            one = step(root, np.full(n, first), rows)
            for twin in (0, 1):
                at = rows if not twin else np.flatnonzero((one >> np.uint64(40)) % np.uint64(4) == 0)
                shift = np.uint64(8 + 16 * twin)
                place = ((first + 1 + (one[at] >> shift) % np.uint64(width - 1)).astype(np.int64)) % width
                yield at, [step(one[at], place, at)]


def parts(n: int, alike) -> list[list[int]]:
    """Connected parts of 0..n-1; alike(i, others) tells which of others are alike to i. A dense group takes few steps."""
    rest, out = np.arange(n), []
    while len(rest):
        seed, rest = rest[0], rest[1:]
        part, queue = [int(seed)], [int(seed)]
        while queue and len(rest):
            ok = alike(queue.pop(), rest)
            new = rest[ok].tolist()
            part += new
            queue += new
            rest = rest[~ok]
        out.append(part)
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key, as tables that end where a key ends: a slice's rows or one group."""
    held: list[pa.RecordBatch] = []
    for b in slices(batches):
        k = b.column(key)
        if held and k[0].as_py() == k[b.num_rows - 1].as_py() == held[-1].column(key)[held[-1].num_rows - 1].as_py():
            held.append(b)
            continue
        last = k[b.num_rows - 1].as_py()
        cut = int(np.searchsorted(np.asarray(k.to_numpy(zero_copy_only=False) == last), True))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [b]
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal keys."""
    cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def signed(docs: DataFrame, permutations: int = PLACES, seed: int = SEED, kind: str = "<u4") -> DataFrame:
    """A row per row of docs: doc_id, hash of the text, hash of the shingle set (null: empty), its size and MinHash vector.

    kind: numpy type of the vector's values, whose upper bits go if it's narrower than 32.
    """
    u = universal(permutations, seed)

    def rows(b: pa.RecordBatch) -> dict:
        out: dict = {"fp": [], "size": [], "sig": []}
        for t in b.column("text").to_pylist():
            s = shingles(t, SHINGLE)
            n = len(s)
            sums = mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.uint64(n)])) if n else None
            out["fp"].append(int(sums.view(np.int64)[0]) if n else None)
            out["size"].append(n)
            out["sig"].append(minhash(s, *u).astype(kind).tobytes() if n else None)
        return out | {"doc_id": b.column("doc_id"), "th": b.column("th")}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")), rows, "doc_id long, th long, fp long, size int, sig binary")


def node_rows(sets: DataFrame, runs: int) -> DataFrame:
    """fp, vector (a byte of each value) and node (key) of each chosen path."""

    def rows(b: pa.RecordBatch) -> dict:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(b.num_rows, PLACES)
        fp = b.column("fp").to_numpy()
        small = [x.tobytes() for x in sig.astype(np.uint8)]
        at, nodes = [], []
        for rows_, (node,) in paths(sig, runs):
            at.append(rows_)
            nodes.append(node)
        place = np.concatenate(at)
        return {"fp": fp[place], "small": [small[i] for i in place.tolist()], "key": np.concatenate(nodes).view(np.int64)}

    return map_batches(sets.select("fp", "sig"), rows, "fp long, small binary, key long")


def crowded(df: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key, count) of keys with more rows than most; marked for broadcast if it's small; None if there are none."""
    found = written(df.groupBy(F.col(key).alias("ck")).agg(F.count("*").alias("cn")).where(F.col("cn") > most), "crowded")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def children() -> Column:
    """The nodes below a row's node (key): one for each of SPLIT places that the node chooses, by the value there."""
    place = [F.pmod(F.xxhash64("key"), F.lit(PLACES // SPLIT)) + F.lit(k * (PLACES // SPLIT)) for k in range(SPLIT)]
    return F.array(*[F.xxhash64("key", p, F.substring("small", p.cast("int") + 1, F.lit(1))) for p in place])


def in_blocks(df: DataFrame, node: int) -> DataFrame:
    """Rows of large nodes (cn rows each), once for each pair of blocks that they belong to: all blocks against each other."""
    df = df.withColumn("nb", F.ceil(F.col("cn") / node).cast("int")).withColumn("blk", F.pmod(F.hash("fp"), F.col("nb")))
    df = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.select(F.xxhash64("key", F.least("blk", "o"), F.greatest("blk", "o")).alias("key"), "fp", "small")


def node_groups(sets: DataFrame, runs: int, node: int) -> DataFrame:
    """(key, fp, small): every key's rows are to be compared, those of a node or of two blocks of a large one.

    A large node is split where its children make fewer comparisons than it does; near copies that no place tells apart
    and nodes split SPLITS times are compared in blocks, which loses nothing.
    """
    df, out = node_rows(sets, runs), None
    for level in range(SPLITS + 1):
        many = crowded(df, "key", node)
        if many is None:
            break
        few = df.join(many, df["key"] == many["ck"], "left_anti").select("key", "fp", "small")
        stay = written(df.join(many, df["key"] == many["ck"]).select("key", "fp", "small", "cn"), "large")
        df = None
        if level < SPLITS:
            below = stay.select("key", "cn", F.explode(children()).alias("child")).groupBy("key", "cn", "child").agg(F.count("*").cast("double").alias("c"))
            worth = below.groupBy("key", "cn").agg(F.sum(F.col("c") * F.col("c")).alias("cost")).where(F.col("cost") < F.col("cn").cast("double") * F.col("cn") * GAIN)
            worth = written(worth.select(F.col("key").alias("ck")), "worth")
            df = stay.join(worth, stay["key"] == worth["ck"], "left_semi").select(F.explode(children()).alias("key"), "fp", "small")
            stay = stay.join(worth, stay["key"] == worth["ck"], "left_anti")
        done = few.unionByName(in_blocks(stay, node))
        out = done if out is None else out.unionByName(done)
        if df is None:
            return out
    return df if out is None else out.unionByName(df)


def loose_edges(sets: DataFrame, runs: int, node: int = NODE) -> DataFrame:
    """(a, b): a spanning forest of the candidates met in each node of the chosen paths."""
    return spanning(node_groups(sets, runs, node))


def spanning(groups: DataFrame, kind: type = np.uint8) -> DataFrame:
    """(a, b): a spanning forest of what looks alike within each key of (key, fp, small); small: vectors of `kind`."""
    rows = groups.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        least = LOOSE * PLACES
        for t in grouped(batches, "key"):
            keys, fp = t.column("key").to_numpy(), t.column("fp").to_numpy()
            small = np.frombuffer(b"".join(t.column("small").to_pylist()), kind).reshape(len(fp), PLACES)
            a: list[int] = []
            b: list[int] = []
            for lo, hi in bounds(keys):
                if hi - lo == 1:
                    continue
                sig, of = small[lo:hi], fp[lo:hi]
                for part in parts(hi - lo, lambda i, rest, sig=sig: (sig[rest] == sig[i]).sum(axis=1) >= least):
                    root = int(of[part].min())
                    for x in set(of[part].tolist()) - {root}:
                        a.append(root)
                        b.append(x)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of all ends of (a, b): label is the least number that v is connected to.

    Each step takes the least label among neighbours and then the label's own label. Nothing is gathered by node, and
    every step is written, so the lineage stays short.
    """
    e = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(sym.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = sym.join(labels.select(F.col("v").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("label").alias("far"))
        nxt = written(step.join(jump, "l", "left").select("v", "old", F.least("l", "far").alias("label")), "labels")
        discard(labels)
        labels = nxt.select("v", "label")
        if nxt.where("label != old").isEmpty():
            discard(e)
            return labels


def row_key(doc_id: str, th: str) -> Column:
    """One key of an id, which may be null, and the hash of a text."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, th)


def _probe(key: Column) -> tuple[Column, Column]:
    """A key's word of the sieve and its bits there."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 20 + 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits = bit(0)
    for i in range(1, SIEVE_BITS):
        bits = bits.bitwiseOR(bit(i))
    return key.bitwiseAND(F.lit(SIEVE - 1)), bits


def sieve(keys: DataFrame) -> DataFrame:
    """(word, bits): a blocked Bloom filter of the column key. SIEVE rows at most, however many keys there are."""
    word, bits = _probe(F.col("key"))
    return keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (column key) without most of those whose key isn't among keys: what is left is worth a shuffle. A full sieve lets all pass."""
    word, bits = _probe(F.col("key"))
    got = rows.join(F.broadcast(sieve(keys)).withColumnsRenamed({"word": "sieve_word", "bits": "sieve_bits"}), word == F.col("sieve_word"))  # SIEVE rows at most
    return got.where(F.col("sieve_bits").bitwiseAND(bits) == bits).drop("sieve_word", "sieve_bits")


def exact_links(groups: DataFrame, threshold: float) -> DataFrame:
    """From (key, fp, mult, blk, cross, text) rows dealt out and sorted by key: (fp, links, root).

    A key's rows are all pairs within a block, or (cross) only those between its two blocks. links counts rows of
    linked sets, root joins each connected part of the group.
    """

    def run(batches):
        schema = pa.schema([("fp", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        for t in grouped(batches, "key"):
            out: list[list] = [[], [], []]
            keys = t.column("key").to_numpy()
            cols = {c: t.column(c).to_pylist() for c in ("fp", "mult", "blk", "cross", "text")}
            for lo, hi in bounds(keys):
                at = list({cols["fp"][i]: i for i in range(lo, hi)}.values())  # a set once
                m = len(at)
                if m < 2:
                    continue
                sets = [shingles(cols["text"][i], SHINGLE) for i in at]
                size = np.array([len(s) for s in sets], np.float64)
                mult = np.array([cols["mult"][i] for i in at], np.int64)
                both = intersections(sets)
                link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(link, False)
                if cols["cross"][lo]:
                    blk = np.array([cols["blk"][i] for i in at])
                    link &= blk[:, None] != blk[None, :]
                n = link @ mult
                fp = np.array([cols["fp"][i] for i in at])
                for part in parts(m, lambda i, rest, link=link: link[i, rest]):
                    root = int(fp[part].min())
                    for i in part:
                        if n[i]:
                            for o, v in zip(out, (int(fp[i]), int(n[i]), root)):
                                o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return groups.mapInArrow(run, "fp long, links long, root long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shared shingles, a slice of them at a time."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float64)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row per row of docs: doc_id, th (hash of the text), class_id, n_links."""
    return linked(docs, signed(docs), lambda sets: loose_edges(sets, runs_for(recall, threshold)), threshold)


def linked(docs: DataFrame, signatures: DataFrame, edges: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """A row per row of docs: doc_id, th, class_id, n_links, from `signed` rows and a way to find loose edges among sets (fp, sig)."""
    t = written(signatures, "signed")
    sets = t.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("mult"), F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.min_by(F.struct("sig", "th", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x"))
    sets = written(sets.select("fp", "mult", "first_id", "size", "x.sig", "x.th", F.col("x.doc_id").alias("at_id")).withColumn("key", row_key("at_id", "th")).drop("at_id", "th"), "sets")
    loose = components(edges(sets.select("fp", "sig")))
    member = written(loose.withColumnRenamed("v", "fp").join(sets.drop("sig"), "fp"), "members")
    total = member.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = member.join(total.select("label", blocks.alias("nb")), "label").withColumn("blk", F.pmod(F.hash("fp"), F.col("nb")))
    text = docs.select(F.col("doc_id").cast("long").alias("d"), "text", F.xxhash64("text").alias("dh")).select(row_key("d", "dh").alias("key"), "text")
    # Members grow with the corpus, so their side is never broadcast: one plan at every size.
    rows = sieved(text, member.select("key")).join(dealt.select("key", "fp", "mult", "label", "nb", "blk").hint("merge"), "key")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select(F.xxhash64("label", F.least("blk", "o"), F.greatest("blk", "o")).alias("key"), "fp", "mult", "blk", (F.col("blk") != F.col("o")).alias("cross"), "text")
    # A key's two blocks carry cross for both: a row of block b meets block o's rows in the key of the pair.
    links = written(exact_links(rows.repartition("key").sortWithinPartitions("key", "fp"), threshold), "links")
    n = links.groupBy("fp").agg(F.sum("links").alias("n"))
    of = components(links.select(F.col("root").alias("a"), F.col("fp").alias("b")))
    named = sets.select("fp", "mult", "first_id").join(of.withColumnRenamed("v", "fp"), "fp", "left").join(n, "fp", "left")
    named = named.withColumn("label", F.coalesce("label", "fp"))
    first = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    result = named.join(first, "label").select("fp", "class_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    own = t.where("fp IS NULL").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return t.where("fp IS NOT NULL").select("doc_id", "th", "fp").join(result, "fp").select("doc_id", "th", "class_id", "n_links").unionByName(own)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows of a class but one: its least doc_id; repeated rows of that stay once. All columns stay.

    Rows with a null id stay unless they have copies with an id.
    """
    drop = joined(docs, threshold).where(F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(row_key("doc_id", "th").alias("key")).distinct()
    # The document is one column meanwhile, so its columns may have any names; one key for both steps, so one shuffle.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("dh")).select("doc", row_key("d", "dh").alias("key"))
    return keyed.join(drop, "key", "left_anti").dropDuplicates(["key"]).select("doc.*")
