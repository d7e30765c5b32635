"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model's kind is byte-pair encoding. A sequence of pieces is the encoding of a text exactly if each piece encodes to
itself and each two neighbours encode to just those two, so encoding is a best-path problem over the states (cut, last
piece) whose arcs weigh 0 where two neighbours go together and minus infinity where they don't. In the max-plus
semiring on {0, -inf} a row of a transfer matrix is a bit mask, and the path is the only one of finite weight.

Short documents are one chunk with one boundary state. A giant one is cut into chunks of CHUNK code points wherever that
falls, a row each, dealt out over all tasks; every chunk yields a transfer matrix from the states at its left edge to
those at its right edge. Neighbouring matrices are combined, RADIX at a time, in rounds of rows, up to the matrix of the
whole text. Its entries are the text's two ends; from there the states at the edges within are worked out level by
level, each group from its own two ends. Then every chunk is backtraced by itself between the states found for its edges.

Null and empty texts have no pieces. Characters outside the vocabulary become bytes. decode(encode(text)) is the text
unless it holds the word mark itself. Repeated rows give repeated results, ties can't arise as the path is unique;
other columns ride along where a query keeps them, whatever their names. An empty table gives an empty result. A very
long text is many rows until its ids are gathered into its own one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_batches, written

#: Code points of a chunk, and matrices or ranges that are combined at a time.
CHUNK, RADIX = 1 << 15, 16
#: Units whose pieces a task remembers (about 250 bytes each); more of them save time and change nothing else.
MEMO = 1_000_000
MARK = "▁"
#: A boundary state: characters from the cut to the edge, and the last piece before the cut.
State = tuple[int, str]


class Places(dict):
    """Unit to its number; one that is missing gets the next number and joins the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, u: str) -> int:
        self[u] = n = len(self)
        self.new.append(u)
        return n


class Pieces:
    """Vocabulary of a sentencepiece BPE file: piece to (id, score)."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.most = memo

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(p[3:-1], 16)] = i
                self.raw.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.raw.append(p.replace(MARK, " ").encode())
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses words")
        # Nothing merges over a word mark that follows another character, nor over a line end that no piece holds.
        cut = "" if any("\n" in p for p in self.id) else "\n"
        self.units = re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + ("|\n" if cut else "")).findall
        self.line = cut
        self.history: dict[str, tuple] = {}
        self.back: dict = {}
        for p in self.id:  # the pieces that encode to themselves, by their reversed characters
            if self._history(p) is None:
                continue
            at = self.back
            for c in reversed(p):
                at = at.setdefault(c, {})
            at[""] = p
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.raw_start = np.cumsum([0, *map(len, self.raw)])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.memo = Places()
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _history(self, p: str) -> tuple | None:
        """Scores of a piece's merges in order, with its last and first symbol before each and at the end; None if it doesn't encode to itself."""
        parts, score = list(p), self.score
        scores, last, first = [], [parts[-1]], [parts[0]]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            last.append(parts[-1])
            first.append(parts[0])
        got = self.history[p] = (scores, last, first)
        return got

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string, by merging the best pair until none is left."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b may be neighbours: the weight of the arc is 0, not minus infinity."""
        row = self.pairs.get(a)
        if row is None:
            row = self.pairs[a] = {}
        got = row.get(b)
        if got is None:
            if self.n_pairs > 2 * self.most:
                self.pairs, self.n_pairs = {a: (row := {})}, 0
            self.n_pairs += 1
            got = row[b] = self._apart(a, b)
        return got

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging a + b never merges over the border: both histories side by side, best score first, the left one on ties."""
        if b[0] == MARK and a[-1] != MARK:
            return True
        sa, last, _ = self.history.get(a) or ([], [a], [a])  # an unknown character has no merges
        sb, _, first = self.history.get(b) or ([], [b], [b])
        i = j = 0
        while True:
            over = self.score.get(last[i] + first[j])
            x = sa[i] if i < len(sa) else -np.inf
            y = sb[j] if j < len(sb) else -np.inf
            if over is not None and over > x and over >= y:
                return False
            if i == len(sa) and j == len(sb):
                return over is None
            if x >= y:
                i += 1
            else:
                j += 1

    def ending(self, s: str, i: int, low: int) -> list[str]:
        """Pieces, or the unknown character, that end at i and begin at low or later."""
        out, at, j = [], self.back, i
        while j > low:
            j -= 1
            at = at.get(s[j])
            if at is None:
                break
            if "" in at:
                out.append(at[""])
        if s[i - 1] not in self.id:
            out.append(s[i - 1])
        return out

    def ids_of(self, p: str) -> list[int]:
        i = self.id.get(p)
        if i is not None:
            return [i]
        return [self.bytes_id[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes_id else [self.unk]

    def unit(self, s: str) -> list[int]:
        """Ids of a run that nothing merges out of: one best path from its left edge, of which each place has one last piece."""
        last: list = [""] + [None] * len(s)
        back, pairs, fits = self.back, self.pairs, self.fits
        for i in range(1, len(s) + 1):
            at, j = back, i
            while j:
                at = at.get(s[j - 1])
                if at is None:
                    break
                j -= 1
                a = last[j]
                if a is not None and "" in at:
                    p = at[""]
                    if not a:
                        last[i] = p
                        break
                    row = pairs.get(a)
                    ok = row.get(p) if row is not None else None
                    if ok or (ok is None and fits(a, p)):
                        last[i] = p
                        break
            if last[i] is None and last[i - 1] is not None and s[i - 1] not in self.id:
                last[i] = s[i - 1]
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return [x for p in reversed(out) for x in self.ids_of(p)]

    def escaped(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode_many(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all escaped texts, where each one's begin and the last one's end). Units met before are looked up."""
        if len(self.memo) > self.most:
            self._forget()
        units = [self.units(s) for s in runs]
        k = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        if self.memo.new:
            got = [self.unit(u) for u in self.memo.new]
            self.memo.new = []
            n = np.array([len(x) for x in got], np.int64)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))])
        n = self.size[k]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.first[k] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])]

    def encode_units(self, s: str) -> list[int]:
        return self.encode_many([s])[0].tolist()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_units(self.escaped(text or ""))

    def decode(self, ids) -> str:
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text

    def spelled(self, ids) -> str:
        """The text of some pieces, wherever they stand."""
        ids = np.asarray(ids, np.int64)
        n = self.raw_start[ids + 1] - self.raw_start[ids]
        ends = np.cumsum(n)
        return self.raw_flat[np.repeat(self.raw_start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode("utf-8", "replace")

    # Chunks: s is a chunk with up to 2 x longest characters of left context, edge the place where the chunk begins.

    def entries(self, s: str, edge: int) -> list[State]:
        """All states at the left edge that the text allows."""
        if not edge:
            return [(0, "")]
        begun = [(edge, "")] if edge < self.longest else []  # the first piece of the text reaches over the edge
        return begun + [(edge - j, p) for j in range(max(1, edge - self.longest + 1), edge + 1) for p in self.ending(s, j, 0)]

    def borders(self, s: str, edge: int) -> tuple[int, int]:
        """First and last place in the chunk that no piece crosses, at least `longest` from either edge; -1 if none."""
        is_cut = lambda i: (s[i] == MARK and s[i - 1] != MARK) or (self.line and (s[i] == self.line or s[i - 1] == self.line))
        first = next((i for i in range(edge + self.longest, len(s) - self.longest) if is_cut(i)), -1)
        last = next((i for i in range(len(s) - self.longest, edge + self.longest, -1) if i < len(s) and is_cut(i)), -1) if first >= 0 else -1
        return (first, last) if 0 <= first < last else (-1, -1)

    def walk(self, s: str, start: dict[int, dict[str, int]], lo: int, hi: int) -> dict[int, dict[str, int]]:
        """From states with masks of the entries they come from: for each cut in (lo, hi], last piece to mask."""
        reach = {i: dict(x) for i, x in start.items()}
        low = min(reach)
        for i in range(lo + 1, hi + 1):
            here: dict[str, int] = {}
            for p in self.ending(s, i, low):
                for a, mask in reach.get(i - len(p), {}).items():
                    if not a or self.fits(a, p):
                        here[p] = here.get(p, 0) | mask
            if here:
                reach[i] = here
        return reach

    def transfer(self, s: str, edge: int) -> dict[State, dict[State, int]]:
        """The chunk's matrix: for each entry state, the exit states of weight 0 (the others weigh minus infinity)."""
        states = self.entries(s, edge)
        start: dict[int, dict[str, int]] = {}
        for k, (back, p) in enumerate(states):
            start.setdefault(edge - back, {})[p] = 1 << k
        first, last = self.borders(s, edge)
        alive = (1 << len(states)) - 1
        if first < 0:
            reach = self.walk(s, start, edge, len(s))
        else:
            head = self.walk(s, start, edge, first)
            alive = reduce(lambda x, y: x | y, head.get(first, {}).values(), 0)
            reach = self.walk(s, {last: {"": alive}}, last, len(s))
        out: dict[State, dict[State, int]] = {}
        for i in range(max(edge + 1, len(s) - self.longest + 1), len(s) + 1):
            for p, mask in reach.get(i, {}).items():
                for k, x in enumerate(states):
                    if p and mask >> k & 1:
                        out.setdefault(x, {})[(len(s) - i, p)] = 0
        if len(s) - edge < self.longest:  # a piece may reach over the whole chunk
            for back, p in states:
                if back + len(s) - edge < self.longest:
                    out.setdefault((back, p), {})[(back + len(s) - edge, p)] = 0
        return out

    def _back(self, s: str, reach: dict[int, dict[str, int]], i: int, p: str, low: int) -> list[str]:
        out = []
        while i > low:
            out.append(p)
            j = i - len(p)
            i, p = j, next((a for a in reach.get(j, {}) if not a or self.fits(a, out[-1])), "")
        return out[::-1]

    def backtrace(self, s: str, edge: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that end in the chunk, on the path from entry to leave."""
        back, a = entry
        i, p = len(s) - leave[0], leave[1]
        if i <= edge:
            return []
        start = {edge - back: {a: 1}}
        first, last = self.borders(s, edge)
        if first < 0:
            got = self._back(s, self.walk(s, start, edge, len(s)), i, p, edge - back)
            return [x for q in got for x in self.ids_of(q)]
        head = self.walk(s, start, edge, first)
        left = self._back(s, head, first, next(iter(head[first])), edge - back)
        tail = self.walk(s, {last: {"": 1}}, last, len(s))
        right = self._back(s, tail, i, p, last)
        return [x for q in left for x in self.ids_of(q)] + self.encode_units(s[first:last]) + [x for q in right for x in self.ids_of(q)]


Matrix = dict[State, dict[State, int]]


def combine(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product: the best weight from a state before x to one after y. Associative."""
    out: Matrix = {}
    seen: dict[frozenset, dict[State, int]] = {}  # rows of x are often alike
    for a, row in x.items():
        key = frozenset(row.items())
        best = seen.get(key)
        if best is None:
            best = seen[key] = {}
            for b, w in row.items():
                for c, v in y.get(b, {}).items():
                    best[c] = max(best.get(c, w + v), w + v)
        if best:
            out[a] = best
    return out


def tree(mats: list[Matrix]) -> Matrix:
    """All matrices combined, neighbours first."""
    while len(mats) > 1:
        mats = [combine(*mats[i : i + 2]) if i + 1 < len(mats) else mats[i] for i in range(0, len(mats), 2)]
    return mats[0]


def ends(whole: Matrix) -> tuple[State, State]:
    """The states before and after a whole text on its path: nothing, and a cut at the very end."""
    at = next((x for x in sorted(whole.get((0, ""), {})) if x[0] == 0), None)
    if at is None:
        raise ValueError("no path through a text")
    return (0, ""), at


def between(mats: list[Matrix], entry: State, leave: State) -> list[State]:
    """The states at all edges of neighbouring matrices on the path of finite weight from entry to leave."""
    after: list[set[State]] = [{entry}]
    for m in mats:
        after.append({c for a in after[-1] for c in m.get(a, {})})
    if leave not in after[-1]:
        raise ValueError("no path between two states")
    out = [leave]
    for k in range(len(mats) - 1, -1, -1):
        out.append(next(a for a in sorted(after[k]) if out[-1] in mats[k].get(a, {})))
    return out[::-1]


def to_text(m: Matrix) -> str:
    """A matrix as JSON: [entries, exits with weights] of rows that are alike."""
    alike: dict[tuple, list[State]] = {}
    for a, row in m.items():
        alike.setdefault(tuple(sorted(row.items())), []).append(a)
    return json.dumps([[list(x), [[b, q, w] for (b, q), w in row]] for row, x in alike.items()])


def from_text(s: str) -> Matrix:
    return {(a, p): {(b, q): w for b, q, w in row} for x, row in json.loads(s) for a, p in x}


@lru_cache(1)
def pieces(path: str, memo: int = MEMO) -> Pieces:
    return Pieces(path, memo)


def cut_up(s: str, chunk: int, longest: int) -> Iterator[tuple[int, str, int]]:
    """(number, chunk with its left context, place of the edge in it)."""
    for k, at in enumerate(range(0, len(s), chunk)):
        low = max(0, at - 2 * longest)
        yield k, s[low : at + chunk], at - low


def encode_chunked(pc: Pieces, text: str, chunk: int, radix: int = RADIX) -> list[int]:
    """The scan in one process: the same steps as encode_giants takes."""
    parts = list(cut_up(pc.escaped(text), chunk, pc.longest))
    if not parts:
        return []
    levels = [[pc.transfer(s, e) for _, s, e in parts]]
    while len(levels[-1]) > 1:
        levels.append([tree(levels[-1][i : i + radix]) for i in range(0, len(levels[-1]), radix)])
    on = list(ends(levels[-1][0]))
    for mats in reversed(levels[:-1]):
        found = [between(mats[i * radix : (i + 1) * radix], *on[i : i + 2]) for i in range(len(on) - 1)]
        on = [s for x in found for s in x[:-1]] + [found[-1][-1]]
    return [x for (_, s, e), a, b in zip(parts, on, on[1:]) for x in pc.backtrace(s, e, a, b)]


def chunks_of(texts: DataFrame, path: str, chunk: int, memo: int = MEMO) -> DataFrame:
    """(sha, k, s, edge): the chunks of (sha, text), with their left context, dealt out by number and not by text."""

    def setup():
        pc = pieces(path, memo)

        def rows(b: pa.RecordBatch) -> dict:
            out: dict = {"sha": [], "k": [], "s": [], "edge": []}
            for sha, t in zip(b.column("sha").to_pylist(), b.column("text").to_pylist()):
                for k, s, e in cut_up(pc.escaped(t), chunk, pc.longest):
                    for c, v in (("sha", sha), ("k", k), ("s", s), ("edge", e)):
                        out[c].append(v)
            return out

        return rows

    cut = map_batches(texts, None, "sha string, k int, s string, edge int", setup)
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    return written(cut.repartition(n, "sha", "k"), "chunks")


def groups_of(level: DataFrame, radix: int) -> DataFrame:
    """(sha, g, ms): up to radix neighbouring matrices of a level in a row, in order."""
    g = level.groupBy("sha", F.expr(f"k div {radix}").cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("x"))
    return g.select("sha", "g", F.col("x.m").alias("ms"))


def boundary_states(chunks: DataFrame, path: str, radix: int = RADIX, memo: int = MEMO) -> DataFrame:
    """(sha, k, a, p, b, q): the states (a, p) and (b, q) at the edges of every chunk, by a tree of products up and down again."""

    def matrices():
        pc = pieces(path, memo)
        return lambda b: {"sha": b.column("sha"), "k": b.column("k"), "m": [to_text(pc.transfer(s, e)) for s, e in zip(b.column("s").to_pylist(), b.column("edge").to_pylist())]}

    def product(b: pa.RecordBatch) -> dict:
        return {"sha": b.column("sha"), "k": b.column("g"), "m": [to_text(tree([from_text(m) for m in ms])) for ms in b.column("ms").to_pylist()]}

    def top(b: pa.RecordBatch) -> dict:
        found = [ends(from_text(m)) for m in b.column("m").to_pylist()]
        return {"sha": b.column("sha"), "k": b.column("k")} | {c: [x[i][j] for x in found] for c, i, j in (("a", 0, 0), ("p", 0, 1), ("b", 1, 0), ("q", 1, 1))}

    def inner(b: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("sha", "k", "a", "p", "b", "q")}
        for x in b.to_pylist():
            on = between([from_text(m) for m in x["ms"]], (x["a"], x["p"]), (x["b"], x["q"]))
            for i, (s, t) in enumerate(zip(on, on[1:])):
                for c, v in zip(out, (x["sha"], x["g"] * radix + i, *s, *t)):
                    out[c].append(v)
        return out

    states = "sha string, k int, a int, p string, b int, q string"
    levels = [written(map_batches(chunks, None, "sha string, k int, m string", matrices), "matrices")]
    n = (levels[0].agg(F.max("k")).first()[0] or 0) + 1
    while n > 1:
        levels.append(written(map_batches(groups_of(levels[-1], radix), product, "sha string, k int, m string"), "products"))
        n = -(-n // radix)
    at = written(map_batches(levels.pop(), top, states), "states")
    while levels:
        both = groups_of(levels.pop(), radix).join(at.withColumnRenamed("k", "g"), ["sha", "g"])
        at = written(map_batches(both, inner, states), "states")
    return at


def encode_giants(texts: DataFrame, path: str, chunk: int = CHUNK, radix: int = RADIX, memo: int = MEMO) -> DataFrame:
    """(sha, ids, ok) of (sha, text): ok if every chunk's pieces decode to the characters between its cuts."""
    chunks = chunks_of(texts, path, chunk, memo)
    states = boundary_states(chunks, path, radix, memo)

    def trace():
        pc = pieces(path, memo)

        def rows(b: pa.RecordBatch) -> dict:
            out: dict = {"sha": b.column("sha"), "k": b.column("k"), "ids": [], "ok": []}
            for x in b.to_pylist():
                s, e = x["s"], x["edge"]
                ids = pc.backtrace(s, e, (x["a"], x["p"]), (x["b"], x["q"]))
                out["ids"].append(ids)
                out["ok"].append(pc.spelled(ids) == s[e - x["a"] : len(s) - x["b"]].replace(MARK, " "))
            return out

        return rows

    traced = written(map_batches(chunks.join(states, ["sha", "k"]), None, "sha string, k int, ids array<int>, ok boolean", trace), "traced")
    whole = traced.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x"), F.bool_and("ok").alias("ok"))  # a text's ids: its own result
    return whole.select("sha", F.flatten("x.ids").alias("ids"), "ok")


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK, keep: tuple[str, ...] = (), order: str | None = None, memo: int = MEMO) -> DataFrame:
    """doc_id, the columns of keep, n_tokens, ids, ids_crc32 and round_trip (decodes to the text) of each document.

    order: one of keep, by which the rows come: ranges of it by task, sorted within, before the short texts are encoded.
    """
    given = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in keep])  # one column meanwhile, so they may have any names
    base = docs.select(given.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    giant = base.where(F.length("text") >= chunk).withColumn("sha", F.sha2("text", 256))
    found = encode_giants(giant.dropDuplicates(["sha"]).select("sha", "text"), path, chunk, memo=memo)
    # A text with a word mark of its own decodes to a space there.
    giant = giant.select("row", "sha", (F.instr("text", MARK) == 0).alias("plain")).join(found, "sha")
    short = base.where(F.length("text") < chunk).select("row", "text", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("boolean").alias("ok"))
    both = short.unionByName(giant.select("row", F.lit(None).cast("string").alias("text"), "ids", (F.col("ok") & F.col("plain")).alias("ok")))
    if order:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = both.repartitionByRange(n, f"row.{order}").sortWithinPartitions(f"row.{order}")

    def setup():
        pc = pieces(path, memo)

        def rows(b: pa.RecordBatch) -> dict:
            texts, done = b.column("text").to_pylist(), b.column("ids")
            parts: list = [None if t is not None else done[i].values.to_numpy() for i, t in enumerate(texts)]
            ok = b.column("ok").to_pylist()
            todo = [i for i, t in enumerate(texts) if t is not None]
            ids, cuts = pc.encode_many([pc.escaped(texts[i]) for i in todo])
            for i, x, y in zip(todo, cuts[:-1].tolist(), cuts[1:].tolist()):
                parts[i] = ids[x:y]
                ok[i] = pc.decode(parts[i]) == texts[i]
            ends = np.cumsum([0, *map(len, parts)])
            return {
                "row": b.column("row"), "n_tokens": np.diff(ends), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32())),
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in parts], "round_trip": ok,
            }

        return rows

    schema = StructType([base.schema["row"], *StructType.fromDDL("n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")])
    return map_batches(both, None, schema, setup).select("row.*", "n_tokens", "ids", "ids_crc32", "round_trip")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text."""

    def setup():
        pc = pieces(path)
        return lambda b: {"doc_id": b.column("doc_id"), "text": [None if x is None else pc.decode(x) for x in b.column("ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), None, "doc_id long, text string", setup)
