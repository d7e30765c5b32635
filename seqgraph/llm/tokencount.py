"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building the pieces.

The vocabulary is a trie with two roots, for pieces that begin a word and for pieces that continue one. Every node has
a failure link and the precomputed number of pieces popped on the way, so each character moves the automaton forward
once and each failure is paid for by a piece.

Words are runs of word characters, and every other visible character by itself. A word that the vocabulary can't
cover counts as one unknown piece, and so does one longer than max_chars (the library's default is 100; the registered
query has no limit). Null and empty texts have 0 pieces; repeated rows give
repeated results; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

_WORDS = re.compile(r"\w+|[^\w\s]")
MAX_CHARS = 100
#: Words whose count a worker remembers; when so many are known it begins anew.
MEMO = 1 << 18
#: Longer words aren't remembered: the memo stays small.
MEMO_CHARS = 100


class PieceCounter:
    """initial: pieces that begin a word; following: pieces that continue one."""

    def __init__(self, initial: set[str], following: set[str], max_chars: int | None = MAX_CHARS):
        self.max_chars = max_chars
        child: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                if not piece:
                    continue
                at = root
                for c in piece:
                    if c not in child[at]:
                        child[at][c] = len(child)
                        child.append({})
                        token.append(False)
                    at = child[at][c]
                token[at] = True
        fail, pops = [-1] * len(child), [0] * len(child)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in child[u].items():
                if token[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    z, extra = fail[u], 0
                    while z >= 0 and c not in child[z]:
                        extra += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = child[z][c], pops[u] + extra
                queue.append(v)
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: str) -> int:
        """Pieces of one word; -1 if the vocabulary can't cover it."""
        child, fail, pops = self.child, self.fail, self.pops
        if self.max_chars is not None and len(word) > self.max_chars:
            return -1
        u = n = 0
        for c in word:
            while c not in child[u]:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = child[u][c]
        while u != 1:
            if u == 0:
                return 0
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n


@lru_cache(2)
def counter_from(model_path: str, max_chars: int | None = MAX_CHARS) -> PieceCounter:
    """Pieces of a sentencepiece file as word pieces: those with the word mark begin words, the others continue them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return PieceCounter({p[1:] for p in pieces if p.startswith("▁")}, {p for p in pieces if not p.startswith("▁")}, max_chars)


def count_text(counter: PieceCounter, memo: dict[str, int], text: str | None) -> tuple[int, int, int]:
    """(words, pieces, unknown words) of a text."""
    words = _WORDS.findall(text or "")
    if len(memo) > MEMO:
        memo.clear()
    total = unknown = 0
    get, count = memo.get, counter.count
    for w in words:
        n = get(w)
        if n is None:
            n = count(w)
            if len(w) <= MEMO_CHARS:
                memo[w] = n
        if n < 0:
            unknown += 1
        else:
            total += n
    return len(words), total + unknown, unknown


def count_tokens(docs: DataFrame, model_path: str, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each document; max_chars None: words of any length are counted."""

    def setup():
        counter, memo = counter_from(model_path, max_chars), {}

        def rows(b: pa.RecordBatch) -> dict:
            got = [count_text(counter, memo, t) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id")} | {k: [x[i] for x in got] for i, k in enumerate(("n_words", "n_tokens", "n_unknown"))}

        return rows

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), None, "doc_id long, n_words long, n_tokens long, n_unknown long", setup)
