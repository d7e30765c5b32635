"""Local assembly: a small graph assembler for the reads at one contig end, as a grouped map."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from itertools import count, takewhile
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import shuffled
from .mapping import MapOptions, chosen_hits, insert_sizes, local_range, map_reads, mate_hits, single_hits

_FLIP = str.maketrans("ACGT", "TGCA")


def flip(s: str) -> str:
    return s[::-1].translate(_FLIP)


#: Paths that a bubble has at most, and how the threshold of what is thin rises.
BRANCHES, RISE = 4, 1.1


class Unitig(NamedTuple):
    """A sequence with its k-mers, their mean count, and how many ways lead on before and after it."""

    seq: str
    kmers: int
    depth: float
    before: int
    after: int

    @property
    def ends_freely(self) -> bool:
        return self.before + self.after <= 1

    @property
    def is_plain(self) -> bool:
        """It has no fork, or a free end."""
        return max(self.before, self.after) <= 1 or not min(self.before, self.after)


class SmallGraph:
    """Contigs over k-mers of a few hundred reads: each has a sequence and the counts of its k-mers."""

    def __init__(self, k: int):
        self.k = k
        self.count: Counter[str] = Counter()
        self.linked: set[str] = set()  # (k+1)-mers seen, canonical

    def insert(self, seq: str, counted: bool = True) -> None:
        k = self.k
        for i in range(len(seq) - k + 1):
            m = seq[i : i + k]
            self.count[min(m, flip(m))] += int(counted)
            if i + k < len(seq):
                e = seq[i : i + k + 1]
                self.linked.add(min(e, flip(e)))

    def percentile(self, p: float) -> int:
        """First count whose running number of k-mers exceeds the share p."""
        values = sorted(v for v in self.count.values() if v)
        if not values:
            return 0
        return values[min(len(values) - 1, max(0, int(len(values) * p)))]

    def _next(self, m: str) -> list[str]:
        return [m[1:] + c for c in "ACGT" if min(m + c, flip(m + c)) in self.linked]

    def unitigs(self) -> dict[str, float]:
        """Maximal unbranched sequences with their mean k-mer count; either strand once."""
        seen: set[str] = set()
        out: dict[str, float] = {}
        for start in sorted(self.count):
            if start in seen:
                continue
            path = [start]
            seen.add(start)
            for way in (0, 1):
                if way:
                    path = [flip(m) for m in reversed(path)]
                while True:
                    nxt = self._next(path[-1])
                    if len(nxt) != 1 or len(self._next(flip(nxt[0]))) != 1 or min(nxt[0], flip(nxt[0])) in seen:
                        break
                    path.append(nxt[0])
                    seen.add(min(nxt[0], flip(nxt[0])))
            seq = path[0] + "".join(m[-1] for m in path[1:])
            out[min(seq, flip(seq))] = sum(self.count[min(m, flip(m))] for m in path) / len(path)
        return out

    def table(self) -> list[Unitig]:
        """The unitigs with their k-mers, mean count and numbers of ways on at either end."""
        k = self.k
        return [Unitig(s, len(s) - k + 1, depth, len(self._next(flip(s[:k]))), len(self._next(s[-k:]))) for s, depth in self.unitigs().items()]

    def drop(self, seqs) -> None:
        for s in seqs:
            for i in range(len(s) - self.k + 1):
                m = s[i : i + self.k]
                self.count.pop(min(m, flip(m)), None)
        gone = {e for e in self.linked if any(min(m, flip(m)) not in self.count for m in (e[:-1], e[1:]))}
        self.linked -= gone

    def drop_bubbles(self) -> None:
        """Of the paths over k k-mers between the same two longer unitigs, BRANCHES at most, the one with the most counts stays.

        The paths may be of several unitigs. They must be all there are, seen from either side. A place that leads to
        what an earlier bubble has lost is left as it is.
        """
        k, found = self.k, self.table()
        starts = {t: (i, way) for i, u in enumerate(found) for way, t in ((1, flip(u.seq[-k:])), (0, u.seq[:k]))}
        lost: set[int] = set()

        def sequence(at: tuple[int, int]) -> str:
            return flip(found[at[0]].seq) if at[1] else found[at[0]].seq

        def fork(start: tuple[int, int]) -> tuple[tuple[int, int], list[list[tuple[int, int]]]] | None:
            """(end, inner unitigs of each path) if all ways on from start meet there after k k-mers."""
            if found[start[0]].kmers == 1:
                return None
            going: list[tuple[list | None, int, tuple[int, int]]] = [(None, 0, start)]
            paths: list[tuple[list, tuple[int, int]]] = []
            while going:
                inner, n, last = going.pop()
                ways = [starts[m] for m in self._next(sequence(last)[-k:])]
                if not ways or any(w[0] in lost for w in ways):
                    return None
                inner, n = ([], 0) if inner is None else ([*inner, last], n + found[last[0]].kmers)
                if n > k:
                    return None
                for w in ways:
                    (paths if n == k else going).append((inner, w) if n == k else (inner, n, w))
                if len(paths) + len(going) > BRANCHES:
                    return None
            ends = {end for _, end in paths}
            if len(paths) < 2 or len(ends) > 1 or ends == {start} or found[paths[0][1][0]].kmers == 1:
                return None
            return paths[0][1], [inner for inner, _ in paths]

        turn = lambda at: (at[0], 1 - at[1])
        for start in sorted((i, way) for i in range(len(found)) for way in (0, 1)):
            there = fork(start)
            back = there and fork(turn(there[0]))
            if not back or back[0] != turn(start):
                continue
            weight = lambda inner: (-sum(found[i].depth * found[i].kmers for i, _ in inner), [sequence(x) for x in inner])
            best, *rest = sorted(there[1], key=weight)
            lost |= {i for inner in rest for i, _ in inner} - {i for i, _ in best}
        self.drop(found[i].seq for i in lost)

    def settle(self, rule: Callable[[Unitig], bool]) -> None:
        """Drops what a rule finds in the unitigs as they are; what is left grows together."""
        self.drop(u.seq for u in self.table() if rule(u))

    def clean(self, longest: int, ceiling: float) -> None:
        """Dead ends, bubbles, and what is thin among the short ones, in this order."""
        limits = [*takewhile(lambda n: n < longest, (1 << i for i in count(1))), longest, longest]
        for limit in limits:  # the last one twice: what it leaves may end freely now
            self.settle(lambda u, n=limit: u.kmers < n and u.ends_freely and not (u.kmers == 1 and u.seq == flip(u.seq)))
        self.drop_bubbles()
        level = min(1.0, ceiling)
        while True:
            thin = [u.depth for u in self.table() if u.kmers < longest and u.is_plain]
            while min(thin, default=math.inf) >= level and level * RISE < ceiling:  # nothing would go at this level
                level *= RISE
            self.settle(lambda u, least=level: u.kmers < longest and u.is_plain and u.depth < least)
            level *= RISE
            if level >= ceiling:
                break


def assemble_end(reads: list[str], end: str, kmin: int = 11, kmax: int = 41, step: int = 6) -> list[str]:
    """Contigs from the reads recruited to one contig end, with growing k; stops at a single contig."""
    longest = max(map(len, reads), default=0)
    out: list[str] = []
    for k in range(kmin, min(kmax, longest) + 1, step):
        g = SmallGraph(k)
        for r in reads:
            g.insert(r)
        high = g.percentile(1 - len(end) / max(1, len(g.count)))
        g.insert(end)
        for c in out:
            g.insert(c, counted=False)
        g.clean(2 * k, high)
        out = sorted(g.unitigs())
        if len(out) == 1:
            break
    return out


def local_assembly(reads: DataFrame, libs: DataFrame, contigs: DataFrame, kmax: int = 41, min_len: int = 200, opt: MapOptions = MapOptions(), kmin: int = 11, step: int = 6) -> DataFrame:
    """(origin_contig, strand, j, seq): contigs built at both ends of long contigs that aren't loops, longer than min_len and kmax.

    A group holds the reads of one end: three for each offset and kind within range.
    """
    c = contigs.where(F.col("flag").bitwiseAND(2) == 0).select("contig_id", "seq").where(F.length("seq") >= opt.min_contig_len)
    m = map_reads(reads, c, opt)
    inserts = insert_sizes(m, reads, libs)
    range_ = local_range(libs, inserts, opt)
    longest = libs.agg(F.max("max_read_len")).first()[0] or 0
    hits = chosen_hits(single_hits(m, range_).unionByName(mate_hits(m, reads, libs, range_)), range_, longest)
    ends = c.select(F.col("contig_id"), F.substring("seq", 1, range_).alias("e0"), F.expr(f"right(seq, {range_})").alias("e1"))
    rows = hits.join(shuffled(reads.select("read_id", "seq")), "read_id").join(shuffled(ends), "contig_id").select("contig_id", "end", "read_id", "seq", F.when(F.col("end") == 0, F.col("e0")).otherwise(F.col("e1")).alias("tail"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("read_id")
        got = [s for s in assemble_end(pdf["seq"].tolist(), pdf["tail"].iloc[0], kmin, kmax, step)]
        keep = [(j, s) for j, s in enumerate(got) if len(s) > min_len and len(s) > kmax]
        return pd.DataFrame({"origin_contig": [key[0]] * len(keep), "strand": [int(key[1])] * len(keep), "j": [j for j, _ in keep], "seq": [s for _, s in keep]}, dtype=object)

    return rows.groupBy("contig_id", "end").applyInPandas(run, "origin_contig string, strand int, j int, seq string")
