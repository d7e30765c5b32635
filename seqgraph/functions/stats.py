"""Statistics on histograms (value, n): percentiles, Nx, trimming, the first local minimum and the depth threshold.

Windows here run over distinct values, not over rows: a histogram of multiplicities has 65,535 values at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_MULT = 65_535


def _up():
    return W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)


def _down():
    return W.orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)


def histogram(df: DataFrame, value: Column | str) -> DataFrame:
    """(value, n)."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def summary(h: DataFrame) -> DataFrame:
    """One row: n, least, greatest, total, mean (integral), variance and sd about the real mean."""
    base = h.agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum(F.col("value") * F.col("n")).alias("total"), F.sum(F.col("value").cast("double") * F.col("value") * F.col("n")).alias("_sq"))
    real = F.col("total") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("_sq") / F.col("n") - real * real)
    return base.select("n", "least", "greatest", "total", F.expr("total div n").alias("mean"), var.alias("variance"), F.sqrt(var).alias("sd"))


def cumulative(h: DataFrame) -> DataFrame:
    """The histogram with c, the count of all values up to each."""
    return h.withColumn("c", F.sum("n").over(_up()))


def percentile(h: DataFrame, p: float) -> DataFrame:
    """One row: the first value whose running count exceeds int(n * p)."""
    t = h.agg(F.floor(F.sum("n") * F.lit(p)).alias("limit"))
    return cumulative(h).crossJoin(F.broadcast(t)).where(F.col("c") > F.col("limit")).agg(F.min("value").alias("value"))  # t has one row


def nx(h: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: the greatest value such that values from it up make up at least the share of the total."""
    t = h.agg(F.sum(F.col("value") * F.col("n")).alias("total"))
    return h.withColumn("c", F.sum(F.col("value") * F.col("n")).over(_down())).crossJoin(F.broadcast(t)).where(F.col("c") >= F.col("total") * F.lit(share)).agg(F.max("value").alias("value"))  # t has one row


def trim(h: DataFrame, share: float) -> DataFrame:
    """The histogram without the outermost values that, whole, make up share / 2 of the count (rounded) at most at either end."""
    t = h.agg(F.floor(F.sum("n") * F.lit(share) / 2 + 0.5).cast("long").alias("cut"))
    d = h.withColumn("lo", F.sum("n").over(_up())).withColumn("hi", F.sum("n").over(_down())).crossJoin(F.broadcast(t))  # t has one row
    return d.where("lo > cut AND hi > cut").select("value", "n")


def trim_low(h: DataFrame, threshold: float) -> DataFrame:
    """Without the values below the threshold."""
    return h.where(F.col("value") >= threshold)


def up_mean(h: DataFrame, p: float) -> DataFrame:
    """One row: mean of the greatest values, down to the one at which their count exceeds int(n * p)."""
    t = h.agg(F.floor(F.sum("n") * F.lit(p)).alias("count"))
    d = h.withColumn("hi", F.sum("n").over(_down())).crossJoin(F.broadcast(t)).where(F.col("hi") - F.col("n") <= F.col("count"))  # t has one row
    return d.agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))


def first_local_minimum(counts: dict[int, int], smoothing: int = 4) -> int:
    """The last least count before `smoothing` greater ones in a row of values that occur; 0 if that's the greatest value."""
    values = np.array(sorted(counts), np.int64)
    if not len(values):
        return 0
    n = np.array([counts[v] for v in values.tolist()], np.int64)
    lows = np.flatnonzero(n <= np.minimum.accumulate(n))  # as low as any before
    followed = np.diff(np.append(lows, len(n))) > smoothing  # so many greater ones come next
    at = int(lows[np.argmax(followed)] if followed.any() else lows[-1])
    return 0 if at == len(n) - 1 else int(values[at])


def median(counts: dict[int, int]) -> int:
    if not counts:
        return 0
    values = sorted(counts)
    running = np.cumsum([counts[v] for v in values])
    return values[int(np.searchsorted(running, running[-1] // 2, "right"))]


def infer_min_depth(h: DataFrame) -> float:
    """Depth below which edges are noise: from the first local minimum, follow the square root of the median of what is left.

    The histogram has MAX_MULT rows at most, so it's collected.
    """
    counts = {int(r.value): int(r.n) for r in h.where(F.col("value") <= MAX_MULT).collect()}
    cov = float(first_local_minimum(counts))
    for _ in range(100):
        counts = {v: n for v, n in counts.items() if v >= math.floor(cov + 0.5)}
        new = math.sqrt(median(counts))
        if abs(new - cov) < 0.01:
            return cov
        cov = new
    return 1.0
