"""Document fingerprints: MinHash over five-word shingles, banded and verified in Spark.

A fingerprint is the least value of each of PERMUTATIONS universal hashes over a text's shingles, as hex; the likeness
of two is the share of equal values. A text without words has a fingerprint of all ones, alike only to its own kind.

Bands of the fingerprints are joined in Spark: sets that share a band's values are candidates, compared by their
fingerprints within the bucket (a large one block against block), and what looks alike is verified by the exact Jaccard
similarity of the whole shingle sets. A document gets the least doc_id of its connected class and its number of links.

Null texts count as empty; texts without words have no links. Repeated rows and ties (equal ids) are ordered by a hash of
their text and keep a row each. Null ids come last in descending order; a class has the least id that isn't null. A table of one row
has itself as the next document, an empty one gives an empty result. Very long texts are worked on whole, a slice at a
time. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import jaccard
from .common import map_batches, minhash, shingles, slices, universal, written

PERMUTATIONS, SHINGLE, SEED = 64, 5, 9
BANDS, THRESHOLD = 16, 0.8


def signature(text: str | None, permutations: int = PERMUTATIONS) -> np.ndarray:
    return minhash(shingles(text, SHINGLE), *universal(permutations, SEED))


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def split_points(docs: DataFrame, partitions: int) -> list[int]:
    """Ids that occur in docs and cut it into about equal ranges; fewer than partitions.

    Quantiles come as doubles, which don't hold every long: the cuts are the greatest ids up to each of them.
    """
    if partitions < 2:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", [i / partitions for i in range(1, partitions)], 0.2 / partitions)
    near = F.array(*[F.lit(c).cast("long") for c in sorted({int(x) for x in found})]) if found else F.array().cast("array<long>")
    tops = docs.groupBy(F.size(F.filter(near, lambda c: c < F.col("doc_id"))).alias("b")).agg(F.max("doc_id").alias("top"))
    return sorted(r.top for r in tops.collect())[:-1]  # a row for each range


def fingerprints(docs: DataFrame, partitions: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """A row per document: its fingerprint and that of its edited text (see edited; next: descending doc_id, at the end the first).

    One shuffle deals whole ranges of ids to tasks, each in descending order, with compressed texts. A range also gets the
    documents at the next lower cut, of which the first is the next document of the range's last. With classes (doc_id,
    th, class_id, n_links; see near_classes) these columns follow, merged within the same ranges; a document that has no
    row there is its own class.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("th"))
    ids = base.select("doc_id")
    cuts = split_points(ids.where(F.col("doc_id").isNotNull()), n)
    # Range r holds ids in (cuts[k-1-r], cuts[k-r]], the highest ids first; null ids are in the last range.
    k = len(cuts)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    above = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))  # cuts below the id
    place = F.when(F.col("doc_id").isNull(), F.lit(k)).otherwise(F.lit(k) - above).alias("r")
    first_id = ids.agg(F.max("doc_id").alias("hi")).first().hi
    # A document at a cut is also carried to the range of the next higher ids; the first document of all to the last range.
    at_cut = F.when(F.array_contains(bounds, F.col("doc_id")), F.lit(k - 1) - above)
    carried = F.array_compact(F.array(at_cut, F.when(F.col("doc_id").eqNullSafe(F.lit(first_id).cast("long")), F.lit(k))))

    def packed(b: pa.RecordBatch) -> dict:
        z = zstandard.ZstdCompressor(level=1)
        return {"doc_id": b.column("doc_id"), "th": b.column("th"), "z": [z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]}

    rows = map_batches(base, packed, "doc_id long, th long, z binary")
    places = F.concat(F.array(F.struct(place, F.lit(0).alias("carry"))), F.transform(carried, lambda r: F.struct(r.alias("r"), F.lit(1).alias("carry"))))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("class_id", "n_links")]
    rows = rows.select("doc_id", "th", "z", F.explode(places).alias("x")).select("doc_id", "th", "z", "x.r", "x.carry", *nothing)
    if classes is not None:
        known = classes.select("doc_id", "th", F.lit(None).cast("binary").alias("z"), place, F.lit(0).alias("carry"), "class_id", F.col("n_links").cast("long"))
        rows = rows.unionByName(known)
    # A partition a range: hashing the ranges' numbers would give some tasks several of them.
    dealt = rows.repartitionById(k + 1, "r").sortWithinPartitions("r", "carry", F.col("doc_id").desc_nulls_last(), F.col("z").isNotNull(), "th")

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if classes is not None:
        ddl += ", class_id long, n_links long"
    schema = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in StructType.fromDDL(ddl)])

    bare = classes is None

    def run(batches):
        a, b = universal(PERMUTATIONS, SEED)
        unpack = zstandard.ZstdDecompressor().decompress
        sig = lambda t: minhash(shingles(t, SHINGLE), a, b)
        held, done = None, False  # held: a document whose next one hasn't come yet; done: the range's carried document has been used
        known: dict[int, tuple] = {}  # classes of one id's texts, which come before them
        known_of = None

        def row(x, nxt):
            d, t, s, own = x
            e = edited(t, nxt[0])
            es = sig(e)
            return d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(s), as_hex(es), likeness(s, es), likeness(s, nxt[1]), *own

        current = None
        for batch in slices(batches):
            out = []
            for d, th, z, r, carry, class_id, n_links in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "z", "r", "carry", "class_id", "n_links"))):
                if r != current:
                    if held is not None:  # can't be: every range that isn't empty has a carried document
                        raise ValueError("a range of ids has no next document")
                    current, done = r, False
                if z is None:
                    if d != known_of:
                        known, known_of = {}, d
                    known[th] = (class_id, n_links)
                    continue
                t = unpack(z).decode("utf-8", "surrogatepass")
                if carry:
                    if not done and held is not None:
                        out.append(row(held, (t, sig(t))))
                    held, done = None, True
                else:
                    s = sig(t)
                    if held is not None:
                        out.append(row(held, (t, s)))
                    own = () if bare else known.get(th, (d, 0)) if d == known_of else (d, 0)
                    held = (d, t, s, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
        if held is not None:
            raise ValueError("a range of ids has no next document")

    return dealt.mapInArrow(run, ddl)


def band_groups(sets: DataFrame, bands: int = BANDS, node: int = jaccard.NODE) -> DataFrame:
    """(key, fp, small): sets (fp, sig of two bytes a value) by the bands whose values they share with others.

    Buckets are counted with map-side aggregation and only keys travel; vectors go with the sets that met. A bucket of
    more than `node` sets is compared block against block.
    """
    width = 2 * PERMUTATIONS // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(bands)])
    banded = sets.select("fp", F.explode(keys).alias("key"))
    shared = banded.groupBy(F.col("key").alias("ck")).agg(F.count("*").alias("cn")).where("cn > 1")
    met = banded.join(shared.hint("merge"), F.col("key") == F.col("ck")).select("key", "fp", "cn")
    met = met.join(sets.select("fp", F.col("sig").alias("small")).hint("merge"), "fp")
    few = met.where(F.col("cn") <= node).select("key", "fp", "small")
    return few.unionByName(jaccard.in_blocks(met.where(F.col("cn") > node), node))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """A row per row of docs: doc_id, th (hash of the text), class_id, n_links, by bands joined and Jaccard verified.

    A pair at the threshold shares a band with probability 1 - (1 - threshold ** (PERMUTATIONS / bands)) ** bands.
    """
    return jaccard.linked(docs, jaccard.signed(docs, PERMUTATIONS, SEED, "<u2"), lambda sets: jaccard.spanning(band_groups(sets, bands, jaccard.NODE), np.uint16), threshold)


def with_classes(docs: DataFrame) -> DataFrame:
    """fingerprints of docs with class_id and n_links."""
    near = near_classes(docs).where(~F.col("class_id").eqNullSafe(F.col("doc_id")) | (F.col("n_links") > 0)).distinct()
    return fingerprints(docs, classes=written(near, "classes"))
