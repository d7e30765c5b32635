"""Toxicity: cumulative-link (proportional odds) regression on sparse text features.

One weight vector is shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k). The output is the
expected severity, sum over k of P(grade >= k); a document is toxic if P(grade >= 1) is at least one half.
Features are the presence of a word and of a short word start, kept if they tell the grades apart.

The labels at hand say toxic or not. Toxic documents are then graded 1 to 3 by terciles of their telling words, so that
severity above 1 says how much of what makes a text toxic it has; labels with grades of their own are used as they are.
Labels of the held-out quarter of the ids (crc32 of the id as text, modulo 4, is 2) are never read by the fit.

Null and empty texts have no features and get the base rates. Labels with a null id or grade don't count, repeated
labels count once with the highest grade, of several texts with one id the least counts; without labels, and in an empty
table, everything there is has severity 0. Repeated rows and ties get equal results. Very long texts are scored whole.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, minhash, shingles, universal, written

#: Bound on labelled documents that the fit reads, for each of the two strata (grade 0, grade above 0).
FIT_ROWS = 3000
#: Bound on features of the fitted model: it's fitted on the driver from 2 x FIT_ROWS documents, with which more can't be told apart.
FIT_FEATURES = 2000
#: Documents of the sample count once if this share of their MinHash values agrees.
NEAR, NEAR_VALUES, NEAR_BANDS = 0.5, 32, 16
#: Lengths of word starts that are features: inflected and compound forms share them.
STARTS = (4, 5)
#: A feature is kept if its share among toxic documents is so many standard errors above that among clean ones.
FIT_Z = 5.0
#: ... and if it's so many times as frequent among them: a word that only long documents have is not a sign.
FIT_RATIO = 8.0
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Presence features of a text: its lower-cased words, and the four- and five-letter starts of longer ones."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for n in STARTS for w in words if len(w) > n}


@dataclass
class OrdinalModel:
    """weights by feature, thresholds in ascending order (one fewer than grades)."""

    weights: dict[str, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.full(1, 30.0))

    def eta(self, text: str | None) -> float:
        return sum(map(self.weights.__getitem__, sorted(f for f in features(text) if f in self.weights)))

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.theta - self.eta(text), -60, 60)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, d: int, y: np.ndarray, grades: int, signs: bool = False, l2: float = 2e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights of d sparse features and ascending thresholds by Adam on the proportional-odds likelihood.

    Row row[i] has feature col[i]; thresholds are a start plus positive gaps. signs: no weight below 0.
    """
    n = len(y)
    p = np.zeros(d + grades - 1)
    share = np.array([max(1e-3, min(1 - 1e-3, (y >= k).mean())) for k in range(1, grades)])
    start = np.log((1 - share) / share)
    p[d] = start[0]
    p[d + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(row, p[col], n)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -60, 60)))  # P(y >= k)
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        pr = np.maximum(upper[i, y] - lower[i, y], 1e-12)
        ds = s * (1 - s)
        dup = np.concatenate([np.zeros((n, 1)), ds], axis=1)[i, y] / pr
        dlo = np.concatenate([ds, np.zeros((n, 1))], axis=1)[i, y] / pr
        grad = np.zeros_like(p)
        grad[:d] = -np.bincount(col, (dup - dlo)[row], d) / n + l2 * p[:d]
        dtheta = np.zeros(grades - 1)
        for k in range(1, grades):
            dtheta[k - 1] = (dup[y == k].sum() - dlo[y == k - 1].sum()) / n
        grad[d] = dtheta.sum()
        for k in range(1, grades - 1):
            grad[d + k] = dtheta[k:].sum() * gaps[k - 1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if signs:
            np.maximum(p[:d], 0, out=p[:d])
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def fit_model(bags: list[list[int]], grade: np.ndarray, chosen: list[str], strong: np.ndarray) -> OrdinalModel:
    """Fits weights for the chosen features. Binary labels are first graded 1 to 3 by terciles of a toxic document's strong features."""
    y = np.asarray(grade)
    if not len(y) or y.min() == y.max() or not chosen:
        return OrdinalModel()
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.array([f for b in bags for f in b], np.int64)
    if y.max() == 1:
        hits = np.bincount(row, strong[col], len(y))
        cut = np.quantile(hits[y == 1], [1 / 3, 2 / 3], method="higher")
        y = np.where(y == 0, 0, 1 + (hits > cut[0]).astype(int) + (hits > cut[1]).astype(int))
        y = np.searchsorted(np.unique(y), y)
    w, theta = fit_ordinal(row, col, len(chosen), y, int(y.max()) + 1, signs=True)
    return OrdinalModel({f: float(w[i]) for i, f in enumerate(chosen)}, theta)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most `rows` labelled documents of grade 0 and as many above, chosen by a hash of the id.

    The sample is written once; the features that tell the grades apart are counted and chosen in Spark.
    """
    lab = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("g")).dropna().groupBy("i").agg(F.max("g").alias("g"))
    picked = [lab.where(cond).orderBy(F.xxhash64("i"), "i").limit(rows) for cond in (F.col("g") <= 0, F.col("g") > 0)]
    ids = picked[0].unionByName(picked[1]).collect()  # 2 x rows at most
    if not ids:
        return OrdinalModel()
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame([(r.i, max(0, r.g)) for r in ids], "i long, g int"))  # 2 x rows at most
    sample = written(docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(small, "i").groupBy("i").agg(F.first("g").alias("g"), F.min("text").alias("text")), "toxicity-sample")
    sample = sample.join(F.broadcast(spark.createDataFrame([(i,) for i in _unlike(sample)], "i long")), "i", "left_semi")  # 2 x rows at most
    size = {bool(r.toxic): r.n for r in sample.groupBy((F.col("g") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return OrdinalModel()

    def counted(b: pa.RecordBatch) -> dict:
        df: tuple[Counter, Counter] = (Counter(), Counter())
        for t, g in zip(b.column("text").to_pylist(), b.column("g").to_pylist()):
            df[g > 0].update(features(t))
        every = sorted(df[0].keys() | df[1].keys())
        return {"f": every, "b": [df[0][f] for f in every], "a": [df[1][f] for f in every]}

    df = map_batches(sample, counted, "f string, b long, a long").groupBy("f").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).where("a + b >= 4")
    rate = (F.col("a") + F.col("b")) / (n1 + n0)
    df = df.withColumn("z", (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12))
    ratio = F.col("a") * n0 / ((F.col("b") + 0.5) * n1)
    top = df.where((F.col("z") >= FIT_Z) & (ratio >= FIT_RATIO)).orderBy(F.desc("z"), "f").limit(FIT_FEATURES).collect()
    chosen = [r.f for r in top]
    strong = np.array([r.z > 0 and r.a * n0 > 20 * r.b * n1 for r in top], bool)
    place = {f: i for i, f in enumerate(chosen)}

    def bags(b: pa.RecordBatch) -> dict:
        return {"i": b.column("i"), "g": b.column("g"), "f": [sorted(place[f] for f in features(t) if f in place) for t in b.column("text").to_pylist()]}

    got = sorted(map_batches(sample, bags, "i long, g int, f array<int>").collect(), key=lambda r: r.i)
    return fit_model([r.f for r in got], np.array([r.g for r in got]), chosen, strong)


def _unlike(sample: DataFrame) -> list[int]:
    """Ids of the bounded sample without near copies of earlier ids: copies of one document would make its words look telling."""
    u = universal(NEAR_VALUES, 1)

    def rows(b: pa.RecordBatch) -> dict:
        return {"i": b.column("i"), "m": [[] if not len(x := shingles(t)) else minhash(x, *u).astype(np.int64).tolist() for t in b.column("text").to_pylist()]}

    by_band: dict[tuple, list[np.ndarray]] = {}
    out = []
    for r in sorted(map_batches(sample, rows, "i long, m array<long>").collect(), key=lambda r: r.i):  # 2 x FIT_ROWS at most
        m = np.array(r.m)
        bands = [(k, *x) for k, x in enumerate(m.reshape(NEAR_BANDS, -1).tolist())] if len(m) else []
        if not any((m == x).mean() >= NEAR for band in bands for x in by_band.get(band, ())):
            out.append(r.i)
            for band in bands:
                by_band.setdefault(band, []).append(m)
    return out


def held_out() -> Column:
    """True for documents whose labels the fit never reads."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity, severity_grade (most thresholds passed at one half), is_toxic, held_out."""

    def rows(b: pa.RecordBatch) -> dict:
        p = [model.at_least(t) for t in b.column("text").to_pylist()]
        return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "expected_severity": [float(x.sum()) for x in p], "severity_grade": [int((x >= 0.5).sum()) for x in p], "is_toxic": [bool(x[0] >= 0.5) for x in p]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")), rows, "doc_id long, expected_severity double, severity_grade int, is_toxic boolean, held_out boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs without those that the model finds toxic; all columns stay."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def clean(t: pa.Array) -> pa.Array:
        return pa.array([bool(model.at_least(x)[0] < 0.5) for x in t.to_pylist()], pa.bool_())

    return docs.where(clean("text"))
