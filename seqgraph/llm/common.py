"""Shared helpers: the shared folder, batch mapping over texts and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.paths import cut_lineage, discard
from ..operators.paths import checkpoint_dir as shared_dir
from ..sources.tables import spread

__all__ = ["discard", "map_batches", "minhash", "mix", "shared_dir", "shingles", "slices", "spread", "universal", "word_hashes", "written"]

#: Rows that Python code looks at together; texts may be long, so Arrow batches (64 MiB by Spark's default) are cut.
BATCH_ROWS = 256


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    return cut_lineage(df, name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of a few rows; empty ones left out."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict] | None, schema: str | StructType, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over small batches. fn (or what setup() returns on the executor) maps a batch to columns by name."""
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup else fn
        for b in slices(batches):
            got = f(b)
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


_IS_WORD = np.zeros(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _IS_WORD[list(_r)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
_SLICE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 14)
        _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
        _inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _INV, np.uint64)]))
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_slice(b: np.ndarray) -> np.ndarray:
    w = np.zeros(len(b) + 2, np.int8)
    w[1:-1] = _IS_WORD[b]
    d = np.diff(w)
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    p, q = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=c[1:])
    return mix((c[end] - c[start]) * q[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words, in order: lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) <= _SLICE:
        return _hash_slice(b)
    parts, at = [], 0
    while at < len(b):  # slices end where a word ends
        end = min(at + _SLICE, len(b))
        while end < len(b) and _IS_WORD[b[end]]:
            end += 1
        parts.append(_hash_slice(b[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words make one shingle, none an empty set."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    return np.unique(mix(s))


def universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (a, b) of a multiply-add universal hash family on 64 bits, a odd."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each permutation, the upper 32 bits of the least hash of the set; all ones for an empty set."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        h = (part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)
        np.minimum(out, h.min(axis=1).astype(np.uint32), out=out)
    return out
