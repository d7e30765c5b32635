"""Secret scans: base patterns plus assignment-aware lexing of source and configuration syntax.

The lexer reads name-literal pairs of Python, JavaScript, JSON, YAML, .env files, shell and HTTP headers: name = "x",
name: str = "x", "name": "x", name: x, name := x, name => x, settings["name"] = "x", Name: Bearer x. A value is an
expression of plain, prefixed, triple-quoted and block literals, bare words, names ($NAME and ${NAME} in shell) and
their concatenation by + or by standing side by side, in brackets over several lines with comments between. Names are
constants: a value's names are replaced by what they stand for, the nearest definition before the use or else the first
one after it, over any number of steps; a commented-out line defines nothing. Keys that a pair is nested in count
towards its name. Each target is scored by how sensitive its name is and by its whole value's length, mix and entropy;
all literals that make up a value that scores high enough are spans. Names are those of a whole text: it has no scopes.

Null and empty texts have no spans. Spans count code points, end exclusive. Repeated rows give repeated results; of
several targets of a literal the highest score counts. An empty table gives an empty result. Very long texts are lexed
whole, in time linear in the text and the steps between names. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEAD = re.compile(r"(?<![\w.\-$])[\"']?([A-Za-z_][\w.\-]*+)(?:\[[\"']([\w.\-]++)[\"']\])?[\"']?[ \t]*+(=>|:=|=(?!=)|:(?!:|//))", re.ASCII)
_NOTED = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\], |]*+=(?!=)", re.ASCII)  # name: type = value
_STRING = re.compile(r"(?i:[rbuf]{1,2})?(?:\"\"\"((?s:.*?))\"\"\"|'''((?s:.*?))'''|\"((?:[^\"\\\n]|\\(?s:.))*+)\"|'((?:[^'\\\n]|\\(?s:.))*+)'|`([^`\n]*+)`)")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>=]++(?:=++(?![^\s\"'`,;(){}\[\]<>]))?+")  # an equals sign only at the end
_BLANK, _GAP = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)*+"), re.compile(r"(?:\s|\\\n|#[^\n]*+|//[^\n]*+)*+")
_DOLLAR = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", re.ASCII)
_SCHEME = re.compile(r"(?i:bearer|basic|digest|token)[ \t]++(?=\S)")
_BLOCK = re.compile(r"[|>][+\-]?[ \t]*+(?=\n)")
_COMMENT = re.compile(r"(?<!\S)(?:#|//|--(?!-))")
_BRACE = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{}]")
_IDENT = re.compile(r"[A-Za-z_][\w.]*+(?:\+[A-Za-z_][\w.]*+)*+", re.ASCII)  # or names put together
_SUB = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive a part of a name is, 0 to 1.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.7, "authorization": 0.9, "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "access": 0.4, "api": 0.4, "key": 0.5, "pin": 0.4, "salt": 0.5,
}
#: What the keys count that a name is nested in.
AROUND = 0.7
_HARMLESS = re.compile(r"(?i)example|changeme|placeholder|dummy|sample|redacted|^x+$|^\*+$|^\$\{|^<|^none$|^null$|^true$|^false$")


def name_score(name: str) -> float:
    """Sensitivity of a target name: noisy-or of its parts' weights."""
    miss = 1.0
    for part in _SUB.findall(name):
        miss *= 1 - NAME_WEIGHTS.get(part.lower(), 0.0)
    return 1 - miss


def literal_score(text: str) -> float:
    """0 to 1: how much a literal looks like a credential, from its length, entropy and mix of characters."""
    n = len(text)
    if text.startswith("-----BEGIN") and n >= 64:
        return 1.0
    if n < 8 or _HARMLESS.search(text) or any(c.isspace() for c in text):
        return 0.0
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(text).values())
    kinds = sum(map(bool, (re.search("[a-z]", text), re.search("[A-Z]", text), re.search("[0-9]", text), re.search("[^A-Za-z0-9]", text))))
    return min(1.0, 0.5 * min(1.0, entropy / 3.5) + 0.15 * kinds + 0.2 * min(1.0, n / 24))


@dataclass
class Pair:
    """An assignment: where it stands, its name, how sensitive the keys around it are, its parts, whether it defines the name.

    A part is the span of a literal, or a name with the span of the literal that it is if nothing defines it (or None).
    """

    at: int
    name: str
    around: float
    parts: list[tuple[str | None, tuple[int, int] | None]]
    defines: bool


def _literal(text: str, a: int, b: int) -> list[tuple[str | None, tuple[int, int] | None]]:
    """The parts of a quoted literal: names after a dollar sign, and what stands between them."""
    m = _SCHEME.match(text, a, b)
    a = m.end() if m else a
    if text.find("$", a, b) < 0:
        return [(None, (a, b))]
    out: list[tuple[str | None, tuple[int, int] | None]] = []
    for m in _DOLLAR.finditer(text, a, b):
        out += [(None, (a, m.start())), (m[1] or m[2], None)]
        a = m.end()
    return [x for x in [*out, (None, (a, b))] if x[0] or x[1][0] < x[1][1]]


def _value(text: str, i: int, indent: int) -> tuple[list[tuple[str | None, tuple[int, int] | None]], int]:
    """(parts of the expression at i, where it ends)."""
    i = _BLANK.match(text, i).end()
    m = _BLOCK.match(text, i)
    if m:  # a block literal: the lines below that are indented deeper
        parts: list[tuple[str | None, tuple[int, int] | None]] = []
        i = m.end() + 1
        while i < len(text):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            first = _BLANK.match(text, i, end).end()
            if first < end and first - i <= indent:
                break
            if first < end:
                parts.append((None, (first, len(text[first:end].rstrip()) + first)))
            i = end + 1
        return parts, i
    parts, depth, wanted = [], 0, True
    end = i
    while i < len(text):
        i = (_GAP if depth else _BLANK).match(text, i).end()
        c = text[i : i + 1]
        if c == "(" and wanted:
            depth += 1
            i += 1
        elif c == ")" and depth:
            depth -= 1
            i = end = i + 1
        elif m := _STRING.match(text, i):
            g = next(g for g in (1, 2, 3, 4, 5) if m[g] is not None)
            parts += _literal(text, *m.span(g))
            i = end = m.end()
            wanted = False
        elif c == "+" and not wanted:
            i = _GAP.match(text, i + 1).end()
            wanted = True
        elif wanted and (m := _SCHEME.match(text, i)):
            i = m.end()
        elif wanted and (m := _BARE.match(text, i)):
            end = m.end()
            if text[end : end + 1] in ("'", '"', "`", "("):  # a plus sign before a literal puts together
                end = max(i + 1, i + len(m[0].rstrip("+")))
            word = text[i:end]
            if "$" in word and _DOLLAR.search(word):
                parts += _literal(text, i, end)
            else:
                ident = _IDENT.fullmatch(word)
                call = ident and text[end : end + 1] in ("[", "(")
                parts.append((word if ident else None, None if call else (i, end)))
            i = end
            wanted = False
        else:
            break
    if len(parts) > 1:  # a bare word is a literal only by itself
        parts = [(name, None if name else span) for name, span in parts]
    return parts, end


def pairs(text: str) -> list[Pair]:
    """All assignments of a text, in order; an assignment within a quoted literal is one of its own."""
    out: list[Pair] = []
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    marks: dict[int, int] = {}  # line to where its comment begins
    closes: dict[int, int] | None = None
    around: list[tuple[float, int, int]] = []  # score of the keys so far, the last one's indent (-1: in braces), where its braces close
    for m in _HEAD.finditer(text):
        line = bisect_right(lines, m.start()) - 1
        begin = lines[line]
        stop = lines[line + 1] - 1 if line + 1 < len(lines) else len(text)
        first = _BLANK.match(text, begin, stop).end()
        if line not in marks:
            c = _COMMENT.search(text, begin, stop)
            marks[line] = c.start() if c else len(text)
        indent = first - begin
        lead = m.start() - first < 8 and not text[first : m.start()].strip("- ")  # the first on its line, or in a list item
        while around and (around[-1][2] <= m.start() if around[-1][1] < 0 else lead and around[-1][1] >= indent):
            around.pop()
        at = m.end()
        if m[3] == ":" and (n := _NOTED.match(text, at)):
            at = n.end()
        name = f"{m[1]}.{m[2]}" if m[2] else m[1]
        parts, _ = _value(text, at, indent)
        above = around[-1][0] if around else 0.0
        out.append(Pair(m.start(), name, above, parts, m.start() < marks[line]))
        if not parts:
            rest = _BLANK.match(text, at).end()
            if text[rest : rest + 1] == "{":
                if closes is None:
                    closes = _matched(text)
                around.append((1 - (1 - above) * (1 - name_score(name)), -1, closes.get(rest, len(text))))
            elif rest >= stop and lead and m[3] == ":":
                around.append((1 - (1 - above) * (1 - name_score(name)), indent, 0))
    return out


def _matched(text: str) -> dict[int, int]:
    """Where each opening brace outside of quotes is closed."""
    out, opened = {}, []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif m[0] == "}" and opened:
            out[opened.pop()] = m.start()
    return out


def resolved(found: list[Pair]) -> list[list[tuple[int, int]]]:
    """For each pair with a sensitive name, the spans of all literals that make up its value, names replaced; else none."""
    of: dict[str, tuple[list[int], list[int]]] = {}  # name to places and numbers of its definitions
    for k, x in enumerate(found):
        if x.defines and x.parts:
            places, numbers = of.setdefault(x.name, ([], []))
            places.append(x.at)
            numbers.append(k)

    def definition(name: str, k: int) -> int | None:
        places, numbers = of.get(name, ([], []))
        i = bisect_left(places, found[k].at)
        return numbers[i - 1] if i else next((n for n in numbers if n != k), None)

    root = list(range(len(found)))  # of a pair that only names an earlier one: where that leads
    for k, x in enumerate(found):
        if len(x.parts) == 1 and x.parts[0][0] and (d := definition(x.parts[0][0], k)) is not None and d < k:
            root[k] = root[d]

    out = []
    for k, x in enumerate(found):
        spans: dict[tuple[int, int], None] = {}
        if target_score(x):
            seen, todo = {k, root[k]}, [(root[k], p) for p in reversed(found[root[k]].parts)]
            while todo:
                at, (name, span) = todo.pop()
                names = name.split("+") if name else []
                known = [root[d] for n in names if (d := definition(n, at)) is not None]
                if known:  # what else is put together with names stands for nothing
                    for d in reversed([d for d in dict.fromkeys(known) if d not in seen]):  # a name that stands for itself adds nothing
                        seen.add(d)
                        todo += [(d, p) for p in reversed(found[d].parts)]
                elif span and span[0] < span[1] and found[at].name not in names:
                    spans[span] = None
        out.append(list(spans))
    return out


def target_score(x: Pair) -> float:
    """How sensitive a pair's name is; the keys around it count for less."""
    return 1 - (1 - name_score(x.name)) * (1 - AROUND * x.around)


def lexed(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Spans of literals in values that reach a sensitive name with target score x literal score of at least threshold."""
    if "=" not in text and ":" not in text:
        return []
    found = pairs(text)
    out: set[tuple[int, int]] = set()
    for x, spans in zip(found, resolved(found)):
        if spans and target_score(x) * literal_score("".join(text[a:b] for a, b in spans)) >= threshold:
            out |= set(spans)
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a lexed literal that lies within a base span adds nothing."""
    base = base_spans(text)
    starts = [x[0] for x in base]
    reach = list(accumulate((x[2] for x in base), max))  # the furthest end of the base spans up to each
    more = [(s, 3, e) for s, e in lexed(text) if not (i := bisect_right(starts, s)) or reach[i - 1] < e]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping ones, replaced by [SECRET]."""
    if not text:
        return text
    _, spans = all_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, and all spans."""

    def rows(b: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")}
        for t in b.column("text").to_pylist():
            base, spans = all_spans(t or "")
            for i, k in enumerate(("n_assign", "n_access", "n_hex")):
                out[k].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_lexed"].append(len(spans) - len(base))
        return out | {"doc_id": b.column("doc_id")}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced and n_chars set to match; all rows and columns stay."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def clean(t: pa.Array) -> pa.Array:
        return pa.array([redacted(x) for x in t.to_pylist()], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else out
