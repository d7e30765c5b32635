"""Column functions on DNA strings: everything stays inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FLIP = str.maketrans("ACGT", "TGCA")
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def rc(s: Column | str) -> Column:
    """Reverse complement of an ACGT string."""
    return F.translate(F.reverse(_c(s)), "ACGT", "TGCA")


def rc_any_case(s: Column | str) -> Column:
    """Reverse complement that folds case and turns everything else into N."""
    return F.regexp_replace(F.translate(F.upper(F.reverse(_c(s))), "ACGT", "TGCA"), "[^ACGT]", "N")


def canonical(s: Column | str) -> Column:
    """The lesser of a string and its reverse complement."""
    return F.least(_c(s), rc(s))


def is_palindrome(s: Column | str) -> Column:
    return _c(s) == rc(s)


def append_base(s: Column | str, base: Column | str) -> Column:
    """Drops the first base and appends one."""
    s = _c(s)
    return F.concat(F.substring(s, F.lit(2), F.length(s)), _c(base))


def prepend_base(s: Column | str, base: Column | str) -> Column:
    """Drops the last base and prepends one."""
    s = _c(s)
    return F.concat(_c(base), F.substring(s, F.lit(1), F.length(s) - 1))


def base_at(s: Column | str, i: Column | int) -> Column:
    """The base at place i, from 0."""
    return F.substring(_c(s), _n(i) + 1, F.lit(1))


def set_base(s: Column | str, i: Column | int, base: Column | str) -> Column:
    """s with the base at place i (from 0) replaced."""
    return F.overlay(_c(s), _c(base), _n(i) + 1, F.lit(1))


def subseq(s: Column | str, start: Column | int, n: Column | int) -> Column:
    """n bases from place start, from 0."""
    return F.substring(_c(s), _n(start) + 1, _n(n))


def rc_subseq(s: Column | str, start: Column | int, n: Column | int) -> Column:
    return rc(subseq(s, start, n))


def n_trim(s: Column | str) -> Column:
    """The first maximal run without N; empty if there's none."""
    return F.regexp_extract(F.upper(_c(s)), "[^N]+", 0)


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Hamming distance of strings of bases of equal length, 31 at a time as packed words."""
    a, b = _c(a), _c(b)

    def word(i: Column) -> Column:
        x = pack(F.substring(a, i, F.lit(31))).bitwiseXOR(pack(F.substring(b, i, F.lit(31))))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a)), F.lit(31)), F.lit(0), lambda n, i: n + word(i))


def similar_enough(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether 1 - edits / longer length reaches least, with edits found within a band of int(longer * (1 - least)).

    A difference in length beyond the band, or a band below one, doesn't pass.
    """
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    band = F.floor(longer * F.lit(1 - least)).cast("int")
    d = F.call_function("levenshtein", a, b, band)  # -1 beyond the band, within which alone it's worked out
    return (band >= 1) & (F.abs(F.length(a) - F.length(b)) <= band) & (d >= 0) & (1 - d / longer >= least)


def colex(edge: Column | str) -> Column:
    """Colexicographic key of a directed (k+1)-mer: its source node reversed, then the last base."""
    e = _c(edge)
    return F.concat(F.reverse(F.substring(e, F.lit(1), F.length(e) - 1)), F.substring(e, F.length(e), F.lit(1)))


def pack(s: Column | str) -> Column:
    """Up to 31 bases as a LONG, two bits each (A 0, C 1, G 2, T 3), the first base highest."""
    return F.coalesce(F.conv(F.translate(_c(s), "ACGT", "0123"), 4, 10).cast("long"), F.lit(0).cast("long"))


def unpack(v: Column | str, k: int) -> Column:
    """k bases from a LONG made by pack."""
    return F.translate(F.lpad(F.conv(_c(v).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def popcount(v: Column | str) -> Column:
    return F.bit_count(_c(v))


def fold_palindrome(s: Column | str, k: int) -> Column:
    """A linear palindromic contig up to and with its middle edge; the rest is the reverse complement of that."""
    s = _c(s)
    return F.substring(s, F.lit(1), F.floor((F.length(s) - k - 1) / 2).cast("int") + k + 1)


def fold_palindrome_loop(s: Column | str, k: int) -> Column:
    """Half of a loop that is its own reverse complement, from behind the first palindromic (k+1)-mer on.

    In Arrow batches: all places of a batch are compared at once, a base and its counterpart at a time.
    """

    def folded(col: pa.Array) -> pa.Array:
        return folded_loops(col, k)

    return F.arrow_udf(folded, "string")(_c(s))


def folded_loops(col: pa.Array, k: int) -> pa.Array:
    """fold_palindrome_loop of a column of strings."""
    found = col.to_pylist()
    data = "".join(x or "" for x in found).encode()
    at = np.cumsum([0, *(len(x or "") for x in found)])
    b = np.frombuffer(data, np.uint8)
    flipped = _COMPLEMENT[b]
    places = max(0, len(b) - k)
    same = np.ones(places, bool)
    for j in range((k + 2) // 2):
        same &= b[j : j + places] == flipped[k - j : k - j + places]
    i = np.flatnonzero(same)
    row = np.searchsorted(at, i, "right") - 1
    inside = i + k < at[row + 1]
    rows, first = np.unique(row[inside], return_index=True)
    turn = dict(zip(rows.tolist(), (i[inside][first] - at[rows]).tolist()))
    short = {r: 0 for r, x in enumerate(found) if x is not None and len(x) <= k and x == x[::-1].translate(_FLIP)}
    turn |= short
    return pa.array([x if r not in turn else x[turn[r] + 1 : turn[r] + 1 + len(x) // 2] for r, x in enumerate(found)], pa.string())


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _n(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x
