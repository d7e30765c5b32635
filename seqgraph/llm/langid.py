"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds, at each place, a bit for every language: a look-up of a character n-gram takes the
AND of a few places and gives all languages that contain it. Per-language popcounts over a text's n-grams, corrected
for each filter's false positives, decide; a n-gram counts the less, the more languages contain it. A language contains
what at least one in a hundred of its sampled documents has; no n-gram is taken from it because another has it, too.

There may be any number of languages (a mask takes as many words as they need); one document is enough to learn one.
The driver holds the filter: a row for each language and n-gram that it contains, of which a sample has 100 times the
distinct n-grams of its mean document at most.

Texts are lower-cased, everything but letters becomes one space. A null text or one without a letter is `und` with
score 0. Ties go to the language with more training documents, then by name. Repeated rows give repeated results;
other columns are not looked at. Without training rows every text is `und`; an empty table gives an empty result. Very
long texts are looked up whole, a slice at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, written

ORDERS = (2, 3, 4)
#: Expected number of training documents for each language, by a hash of the id.
FIT_ROWS = 2000
#: A language contains an n-gram if this share of its sampled documents has it.
FIT_SHARE = 0.01
_SLICE = 1 << 20
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to lower-cased letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def letters(text: str | None) -> np.ndarray:
    """Lower-cased letters with single spaces around words; empty if there's no letter."""
    cp = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    cp = np.concatenate([[32], cp, [32]]).astype(np.uint32)
    space = cp == 32
    cp = cp[~(space & np.concatenate([[False], space[:-1]]))]
    return cp if len(cp) > 1 else cp[:0]


def grams_of(cp: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of the given letters, repeats included."""
    c = cp.astype(np.uint64)
    h = np.full(max(0, len(c) - n + 1), n, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x200000000367) + c[j : len(c) - n + 1 + j]
    return mix(h)


def grams(cp: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Hashes of all n-grams, or of those that begin at the first `starts` letters."""
    return np.concatenate([grams_of(cp if starts is None else cp[: starts + n - 1], n) for n in ORDERS])


def weights_of(n: int) -> np.ndarray:
    """Weight of an n-gram by the number of languages (0 to n) that contain it: they share a vote. In none counts as in one."""
    return 1 / np.maximum(1, np.arange(n + 1))


@dataclass
class LanguageFilters:
    """langs in order of their bits; masks: the sliced filter, a row of mask words for a place; rate: false positives of each language."""

    langs: list[str]
    masks: np.ndarray
    rate: np.ndarray
    hashes: int = 2

    @classmethod
    def build(cls, by_lang: dict[str, np.ndarray], order: list[str], hashes: int = 2) -> LanguageFilters:
        most = max([1, *map(len, by_lang.values())])
        bits = max(10, int(np.ceil(np.log2(most * hashes * 8))))
        kind, width = (np.uint8, 8) if len(order) <= 8 else (np.uint64, 64)
        masks = np.zeros((1 << bits, max(1, -(-len(order) // width))), kind)
        for i, lang in enumerate(order):
            for place in cls._places(by_lang[lang], bits, hashes):
                masks[place, i // width] |= kind(1 << i % width)  # the same bit for all, so repeated places do no harm
        rate = np.array([float(((masks[:, i // width] >> kind(i % width)) & kind(1)).mean()) ** hashes for i in range(len(order))])
        return cls(order, masks, rate, hashes)

    @staticmethod
    def _places(g: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
        """The places of each n-gram: disjoint bits of its hash."""
        return [((g >> np.uint64(64 - bits * (j + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(hashes)]

    def look_up(self, g: np.ndarray) -> np.ndarray:
        """For each n-gram, the mask words of the languages that contain it."""
        bits = len(self.masks).bit_length() - 1
        places = self._places(g, bits, self.hashes)
        out = self.masks[places[0]]
        for p in places[1:]:
            out = out & self.masks[p]
        return out

    def tally(self, found: np.ndarray) -> np.ndarray:
        """Look-ups by language (the last row: all) and popcount of their mask."""
        n = len(self.langs)
        if self.masks.dtype == np.uint8:
            by_mask = np.bincount(found[:, 0], minlength=256)
            pop = _BITS.sum(axis=1).clip(0, n)
            return np.stack([np.bincount(pop[x], by_mask[x], n + 1) for x in (*(_BITS[:, i] == 1 for i in range(n)), slice(None))]).astype(np.int64)
        pop = np.bitwise_count(found).sum(axis=1, dtype=np.int64).clip(0, n)
        has = (((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool) for i in range(n))
        return np.stack([np.bincount(pop[x], minlength=n + 1) for x in (*has, slice(None))])

    def predict(self, text: str | None) -> tuple[str, float]:
        cp = letters(text)
        if not len(cp) or not self.langs:
            return "und", 0.0
        counts: np.ndarray | int = 0
        step = max(ORDERS) - 1
        for at in range(0, max(1, len(cp) - step), _SLICE):  # n-grams that begin in a slice; the last slice has the short ends
            last = at + _SLICE >= len(cp) - step
            part = cp[at:] if last else cp[at : at + _SLICE + step]
            counts = counts + self.tally(self.look_up(grams(part, None if last else _SLICE)))
        weight = counts @ weights_of(len(self.langs))
        hits, n = weight[:-1], weight[-1]
        true = np.clip((hits - self.rate * n) / (1 - self.rate + 1e-12), 0, None)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum()) if true.sum() > 0 else 1 / len(self.langs)


def held_out() -> F.Column:
    """True for documents that the fit never reads."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageFilters:
    """Learns the filters from a bounded sample of the documents outside the held-out quarter that have a lang.

    About `rows` documents a language, by a hash of the id; all of a language that has fewer.
    """
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count()
    order = [r.lang for r in counts.orderBy(F.desc("count"), "lang").select("lang").collect()]  # a row for each language
    if not order:
        return LanguageFilters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    hashed = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    share = F.broadcast(counts.select(F.col("lang").alias("of"), (F.lit(float(rows)) / F.col("count")).alias("share")))  # a row for each language
    sample = known.join(share, F.col("lang") == F.col("of")).where(hashed < F.col("share")).select("lang", "text")

    def counted(b: pa.RecordBatch) -> dict:
        out: dict = {"lang": [], "g": [], "df": []}
        by: dict[str, list] = {}
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            by.setdefault(lang, []).append(np.unique(grams(letters(t))))
        for lang, all_grams in by.items():
            g, n = np.unique(np.concatenate(all_grams), return_counts=True)
            for c, v in (("lang", [lang] * (len(g) + 1)), ("g", [None, *g.view(np.int64).tolist()]), ("df", [len(all_grams), *n.tolist()])):
                out[c] += v
        return out

    df = written(map_batches(sample, counted, "lang string, g long, df long").groupBy("lang", "g").agg(F.sum("df").alias("df")), "grams")
    total = F.broadcast(df.where("g IS NULL").select(F.col("lang").alias("of"), F.col("df").alias("all")))  # a row for each language
    kept = df.where("g IS NOT NULL").join(total, F.col("lang") == F.col("of")).where(F.col("df") >= F.lit(FIT_SHARE) * F.col("all")).select("lang", "g")
    found = kept.toArrow()
    lang, g = np.asarray(found.column("lang").to_pylist(), object), found.column("g").to_numpy().view(np.uint64)
    return LanguageFilters.build({x: np.sort(g[lang == x]) for x in order}, order)


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""

    def rows(b: pa.RecordBatch) -> dict:
        got = [filters.predict(t) for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    # held_out is passed along, never read for a prediction
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")), rows, "doc_id long, held_out boolean, lang_pred string, score double")
