"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqgraph.llm import common, fingerprint, jaccard, langid, mixing, pieces, quality, secrets, tokencount, tokenfile, toxicity

public = pytest.importorskip("public_tokenizers")
PIECES, BPE = str(public.path("piece_bpe_32k.model")), str(public.path("byte_bpe_50k.json"))
WORDS = "the of and to in that it is was for on with river stone light paper garden window silver morning quiet letter bridge market".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, ids string, words string, th long, mix_b string, r int"


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "k", 1, "x", "w", 2, "b", 3) for i, t, lang, src in rows], SCHEMA)


def odd_rows():
    long_text = prose(40_000, 5)
    base = prose(120, 1)
    return [
        (0, None, None, None), (1, "", "en", "a"), (2, "   \n\t ", "en", "a"), (3, base, "en", "a"), (3, base, "en", "a"), (4, base, None, "b"),
        (5, base + " extra words", "en", "b"), (None, prose(30, 2), "en", None), (6, long_text, "en", "a"), (7, "one two", "fr", "c"), (8, "é😀日本   x", "fr", "c"),
        (9, "a" * 50_000, "en", "a"), (10, "12345 67890", None, "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


LABELS = "doc_id long, quality int, toxic int"


# ------------------------------------------------------------------ 1


def toxic_docs():
    rows, labels = [], []
    for i in range(240):
        t = prose(80, i)
        bad = i % 4 == 0
        if bad:
            t = " ".join([t, *["scoundrel", "villainous"][: 1 + i % 8 // 4]])
        rows.append((i, t, "en", "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_docs()
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], LABELS))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].is_toxic == bool(t) for i, _, t in labels)
    assert np.all(np.diff(model.theta) > 0)
    assert all(abs(got[i].expected_severity - sum(1 / (1 + math.exp(th - model.eta(t))) for th in model.theta)) < 1e-9 for i, t, _, _ in rows[:20])
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, _, t in labels if not t}


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 6))
    eta = x @ np.array([2.0, 2.0, 1.0, 0, 0, -1])
    y = np.digitize(eta + rng.logistic(size=400), [1.0, 3.0])
    row, col = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, col, 6, y, 3)
    assert w[0] > 1 and w[1] > 1 and w[5] < 0 and abs(w[3]) < 0.8 and theta[0] < theta[1]


def test_toxicity_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (7, 1, None), (6, 1, 0)], LABELS)
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == len(odd_rows())
    empty = spark.createDataFrame([], LABELS)
    m = toxicity.fit(odd, empty)
    assert [r.is_toxic for r in toxicity.score(odd, m).collect()] == [False] * len(odd_rows())
    assert toxicity.score(none, toxicity.fit(none, empty)).count() == 0
    assert toxicity.drop_toxic(odd, m).columns == odd.columns


# ------------------------------------------------------------------ 2


def greedy(initial, following, word):
    at, n = 0, 0
    while at < len(word):
        pool = following if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_piece_counts_match_greedy():
    r = random.Random(4)
    for _ in range(300):
        make = lambda n: {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(n)}
        a, b = make(8), make(8)
        c = tokencount.PieceCounter(a, b)
        for _ in range(40):
            w = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            assert c.count(w) == greedy(a, b, w), (a, b, w)


def test_piece_counts_match_library(spark, odd):
    from tokenizers import Tokenizer, models

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ps = [sp.id_to_piece(i) for i in range(259, sp.get_piece_size())]
    vocab = {("##" + p if not p.startswith("▁") else p[1:]): i for i, p in enumerate(ps) if p.strip("▁")} | {"[UNK]": 99_999}
    tok = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    got = {r.doc_id: r for r in tokencount.count_tokens(odd, PIECES).collect()}
    for i, t, _, _ in odd_rows():
        words = re.findall(r"\w+|[^\w\s]", t or "")
        want = {w: len(tok.encode(w, add_special_tokens=False).ids) for w in set(words)}
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(want[w] for w in words)), i


def test_long_words_are_counted(spark, tmp_path):
    from tokenizers import Tokenizer, models

    import sentencepiece
    from seqgraph.llm import queries

    r = random.Random(8)
    long = ["a" * 50_000, "".join(r.choice("abcdefghij0123456789") for _ in range(600)), "日本" * 200, "b" * 101]
    frame(spark, [(i, f"see {w}, {w}", "en", "a") for i, w in enumerate(long)]).write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ps = [sp.id_to_piece(i) for i in range(259, sp.get_piece_size())]
    vocab = {("##" + p if not p.startswith("▁") else p[1:]): i for i, p in enumerate(ps) if p.strip("▁")} | {"[UNK]": 99_999}
    tok = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000))
    got = {x.doc_id: x for x in queries.op2_token_counts(spark, str(tmp_path)).collect()}
    for i, w in list(enumerate(long))[1:]:  # the library takes too long for the first
        n = [len(tok.encode(x, add_special_tokens=False).ids) for x in ("see", w, ",")]
        assert (got[i].n_words, got[i].n_tokens) == (4, n[0] + 2 * n[1] + n[2])
    assert got[0].n_tokens > 1000


# ------------------------------------------------------------------ 3


def lang_rows():
    fr = "le la les des une dans pour avec jardin rivière papier fenêtre matin lumière pierre lettre marché".split()
    return [(i, prose(40, i, fr if i % 3 == 0 else WORDS), "fr" if i % 3 == 0 else "en", "a") for i in range(200)]


def test_language_held_out(spark):
    docs = frame(spark, lang_rows())
    rows = langid.predict(docs, langid.fit(docs)).collect()
    truth = {i: lang for i, _, lang, _ in lang_rows()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in rows)


def test_filters_have_no_false_negatives():
    r = np.random.default_rng(2)
    sets = {x: r.integers(0, 1 << 63, 3000, dtype=np.uint64) for x in ("a", "b", "c")}
    f = langid.LanguageFilters.build(sets, ["a", "b", "c"])
    for i, x in enumerate("abc"):
        assert ((f.look_up(sets[x])[:, 0] >> i) & 1).all()
        other = f.look_up(r.integers(0, 1 << 63, 20_000, dtype=np.uint64))[:, 0]
        assert abs(((other >> i) & 1).mean() - f.rate[i]) < 0.02


def predict_py(text, sets, order):
    """Languages that contain an n-gram share its vote; plain sets instead of filters. Also the margin of the best."""
    t = re.sub(r"[^\W\d_]", lambda m: m[0].lower()[0], re.sub(r"[\W\d_]+", " ", f" {text or ''} "))
    got = dict.fromkeys(order, 0.0)
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            have = [x for x in order if t[i : i + n] in sets[x]]
            for x in have:
                got[x] += 1 / len(have)
    best = sorted(got.values(), reverse=True)
    return max(order, key=lambda x: got[x]), (best[0] - (best[1:] or [0])[0]) / max(1.0, sum(best)), t.strip() == ""


@pytest.mark.parametrize("n_langs", [3, 70])
def test_language_matches_plain_sets(spark, n_langs):
    """More languages than a mask word has bits, each with one to three documents; every one of them can be predicted."""
    r = random.Random(4)
    vocab = {f"l{k}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(r.randint(2, 7))) for _ in range(60)] for k in range(n_langs)}
    shared = [x[0] for x in vocab.values()]
    rows = []
    for lang, words in vocab.items():
        free = [i for i in range(len(rows) * 10, len(rows) * 10 + 40) if zlib.crc32(str(i).encode()) % 4 != 2]
        rows += [(free[j], " ".join(r.choice(words + shared) for _ in range(60)), lang, "a") for j in range(1 + len(rows) % 3)]
    rows = list({x[0]: x for x in rows}.values())
    order = sorted({x[2] for x in rows}, key=lambda x: (-sum(y[2] == x for y in rows), x))
    sets = {x: set() for x in order}
    for _, t, lang, _ in rows:
        s = f" {t} "
        sets[lang] |= {s[i : i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)}
    f = langid.fit(frame(spark, rows))
    assert f.langs == order and f.masks.shape[1] == (1 if n_langs == 3 else 2)
    tests = [(1000 + i, " ".join(r.choice(vocab[x]) for _ in range(30)) + ", 42!", None, "b") for i, x in enumerate(order)]
    for row in langid.predict(frame(spark, tests), f).collect():
        want, margin, empty = predict_py(tests[row.doc_id - 1000][1], sets, order)
        assert not empty and (row.lang_pred == want or margin < 0.02)
        assert row.lang_pred == order[row.doc_id - 1000]


def test_language_ties_go_to_the_larger(spark):
    f = langid.LanguageFilters.build({"b": langid.grams(langid.letters("same text")), "a": langid.grams(langid.letters("same text"))}, ["b", "a"])
    assert f.predict("same text")[0] == "b"


def test_language_slices_change_nothing(spark, monkeypatch):
    docs = frame(spark, lang_rows())
    f = langid.fit(docs)
    text = prose(500, 3)
    want = f.predict(text)
    monkeypatch.setattr(langid, "_SLICE", 64)
    assert f.predict(text) == want


def test_language_odd_inputs(spark, odd, none):
    got = {r.doc_id: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 10)) and got[3].lang_pred in ("en", "fr")
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


# ------------------------------------------------------------------ 4


def base_py(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c = Counter(wins)
    inside = set()
    for i, w in enumerate(wins):
        if c[w] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def js_py(p, q):
    p, q = np.array(p) / sum(p), np.array(q)
    m = (p + q) / 2
    t = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0, (t(p) + t(q)) / 2))


def test_quality_base_and_verdict(spark, odd):
    r = random.Random(7)
    rows = [*odd_rows()]
    for i in range(20, 60):
        t = prose(r.randint(5, 60), i)
        parts = [r.choice([t, prose(9, 1), "# * $ <b>", "x y"]) for _ in range(r.randint(1, 6))]
        rows.append((i, r.choice(["\n", " ", "\r\n", "\x0b"]).join(parts), r.choice(["en", None]), "a"))
    rows.append((99, " ".join("%&|<>"[j % 5] * (12 + j) for j in range(60)), "en", "a"))
    docs = frame(spark, rows)
    refs = {r.lang: r.asDict() for r in quality.references(docs).collect()}
    assert set(refs) == {"en", "fr", None}
    for lang, ref in refs.items():  # the references by plain code
        c = Counter(w for _, t, x, _ in rows if x == lang for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") if len(w) <= quality.COMMON_CHARS)
        top = sorted((w for w in c if c[w] >= sum(c.values()) * quality.COMMON_SHARE), key=lambda w: (-c[w], w))[: quality.COMMON_WORDS]
        assert ref["ref_words"] == top and all(abs(x - c[w] / sum(c[v] for v in top)) < 1e-9 for w, x in zip(top, ref["word_shares"]))
        whole = "".join(t or "" for _, t, x, _ in rows if x == lang)
        assert abs(ref["chars"][0] - sum("a" <= x <= "z" for x in whole) / len(whole)) < 1e-9
    got = {}
    for x in quality.judged(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    for i, t, lang, _ in rows:
        x = got[i][0]
        want = base_py(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want, i
        ref = refs[lang]
        t = t or ""
        kinds = [sum(map(f, t)) for f in (lambda c: "a" <= c <= "z", lambda c: c in " \t\n\x0b\x0c\r", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9")]
        punct = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in t)
        kinds += [punct, len(t) - sum(kinds) - punct]
        cd = js_py(kinds, ref["chars"]) if len(t) >= quality.MIN_CHARS else None
        n = [t.split().count(w) for w in ref["ref_words"]]
        wd = js_py(n, ref["word_shares"]) if sum(n) >= quality.MIN_COMMON else None
        assert (x.char_distance is None) == (cd is None) and abs((x.char_distance or 0) - (cd or 0)) < 1e-9, i
        assert (x.word_distance is None) == (wd is None) and abs((x.word_distance or 0) - (wd or 0)) < 1e-9, i
        assert x.kept == (not want[-1] and (cd or 0) <= quality.MAX_CHAR_DISTANCE and (wd or 0) <= quality.MAX_WORD_DISTANCE)
    assert not got[99][0].kept and not got[99][0].base_failed


def test_quality_empty(none):
    assert quality.judged(none).count() == 0


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_quality_matches_its_sql(spark, tmp_path, monkeypatch, broadcast):
    """A third of the languages null, some of those texts in another script; by either plan."""
    import duckdb

    from seqgraph.llm import oracle, queries

    monkeypatch.setattr(quality, "BROADCAST_LANGS", broadcast)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none_of = F.col("doc_id") % 3 == 0
    docs = docs.withColumn("lang", F.when(~none_of, F.col("lang"))).withColumn("text", F.when(none_of & (F.col("doc_id") % 2 == 0), F.upper("text")).otherwise(F.col("text")))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_words, n_repeat_words, base_failed, kept, char_distance, word_distance FROM ({oracle.QUALITY})").fetchall()
    key = lambda r: [-1 if x is None else x for x in r]
    got = [tuple(r) for r in queries.op4_quality(spark, str(tmp_path)).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance").collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 200


# ------------------------------------------------------------------ 5


@pytest.fixture(scope="module")
def pc():
    return pieces.Pieces(PIECES)


def texts(n, seed):
    r = random.Random(seed)
    atoms = ["the", "ing", "er", " in", "  ", " ", "tion", "a", "e", "==", "00", "\n", "é", "日本", "😀", "\t", "xq", "----", "▁"]
    return ["".join(r.choice(atoms) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_pieces_match_library(pc):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*texts(300, 1), "", " ", "a" * 300, " " * 70, "=" * 333]:
        ids = sp.encode(t)
        assert pc.encode(t) == ids
        assert pc.decode(ids) == sp.decode(ids)
        for chunk in (1, 3, 16, 17, 50):
            assert pieces.encode_chunked(pc, t, chunk) == ids


def test_product_of_matrices_is_associative(pc):
    s = pc.escaped("aaaa the====----  tionsing" * 4)
    m = [pc.transfer(x, e) for _, x, e in pieces.cut_up(s, 9, pc.longest)]
    left = m[0]
    for x in m[1:]:
        left = pieces.combine(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = pieces.combine(x, right)
    assert left == right == pieces.tree(m)


def test_piece_documents(spark, odd, none, pc):
    got = pieces.encode_documents(odd, PIECES, chunk=1000, keep=("source",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(odd_rows()) and len(by[3]) == 2
    for i, t, _, src in odd_rows():
        for r in by[i]:
            assert r.ids == pc.encode(t) and r.n_tokens == len(r.ids) and r.round_trip and r.source == src
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.encode_documents(none, PIECES).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(odd, PIECES), PIECES).collect()}
    assert all(back[i] == (t or "") for i, t, _, _ in odd_rows())


def test_tree_decides_the_states(pc, monkeypatch):
    t = "".join(texts(40, 3))
    ids = pc.encode(t)
    assert pieces.encode_chunked(pc, t, 20, 3) == ids
    # A product that loses a state of its last matrix: the path's own is among them.
    monkeypatch.setattr(pieces, "combine", lambda x, y, f=pieces.combine: {a: {b: w for b, w in row.items() if b[0]} for a, row in f(x, y).items()})
    with pytest.raises(ValueError):
        pieces.encode_chunked(pc, t, 20, 3)


def test_matrix_text_round_trip(pc):
    s = pc.escaped("some text of a few words == 00 é😀")
    for _, x, e in pieces.cut_up(s, 9, pc.longest):
        m = pc.transfer(x, e)
        assert pieces.from_text(pieces.to_text(m)) == m


def test_chunks_of_one_giant_are_tasks_of_their_own(spark, pc):
    t = prose(30_000, 8)
    chunks = pieces.chunks_of(spark.createDataFrame([("x", t)], "sha string, text string"), PIECES, 4096)
    n = -(-(len(t) + 1) // 4096)
    assert chunks.count() == n
    by_task = [r.n for r in pieces.chunks_of(spark.createDataFrame([("x", t)], "sha string, text string"), PIECES, 4096).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(by_task) == 4 and max(by_task) < n  # four partitions in this session
    got = pieces.encode_giants(spark.createDataFrame([("x", t)], "sha string, text string"), PIECES, 4096, radix=2).collect()
    assert [(r.sha, r.ids, r.ok) for r in got] == [("x", pc.encode(t), True)]


def test_giant_with_a_mark_and_clashing_columns(spark, pc):
    long = "".join(texts(60, 4)) + " é😀"
    df = spark.createDataFrame([(1, long, "a", 1), (2, long, "b", 2), (2, long, "b", 2), (3, None, "c", 3)], "doc_id long, text string, sha string, ids int")
    got = sorted(pieces.encode_documents(df.withColumnRenamed("ids", "row"), PIECES, chunk=100, keep=("sha", "row")).collect(), key=lambda r: (r.doc_id, r.row))
    assert [(r.doc_id, r.sha, r.row) for r in got] == [(1, "a", 1), (2, "b", 2), (2, "b", 2), (3, "c", 3)]
    assert got[0].ids == got[1].ids == pc.encode(long) and got[3].ids == []
    assert [r.round_trip for r in got] == [pc.decode(pc.encode(long)) == long] * 3 + [True]


# ------------------------------------------------------------------ 6


def edf_py(weights, blocks):
    """Slots by trying every source at every slot: among released blocks that with the earliest deadline."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    share = {s: w / sum(exact.values()) for s, w in exact.items()}
    done, out, t = Counter(), [], 0
    while any(done[s] < n for s, n in blocks.items()):
        ready = []
        for s, w in share.items():
            j = done[s] + 1
            if j <= blocks[s] and math.floor((j - 1) / w) <= t:
                due = math.ceil(j / w)
                ready.append((due, -(1 if due != j / w else 0), -w, str(s), s))
        if ready:
            s = min(ready)[-1]
            out.append((s, done[s], t))
            done[s] += 1
        t += 1
    return out


def test_slots_match_brute_force():
    r = random.Random(3)
    for _ in range(60):
        w = {f"s{i}": r.choice([r.randint(1, 40), r.random(), Fraction(1, 3)]) for i in range(r.randint(1, 9))}
        blocks = {s: r.randint(0, 60) for s in w}
        assert list(mixing.slots_of(w, blocks)) == edf_py(w, blocks)


def test_deviation_from_given_weights():
    """Less than a block from the weights as given, over many times the slots that a whole cycle of them needs."""
    r = random.Random(5)
    for _ in range(20):
        w = {f"s{i}": r.choice([r.randint(1, 40), Fraction(1, 3), r.random()]) for i in range(r.randint(1, 12))}
        exact = {s: Fraction(x) for s, x in w.items()}
        total, seen = sum(exact.values()), Counter()
        for s, _, t in mixing.slots_of(w, dict.fromkeys(w, 10**6)):
            seen[s] += 1
            if t % 13 == 0:
                assert all(abs(seen[x] - (t + 1) * v / total) < 1 for x, v in exact.items())
            if t > 3000:
                break


def test_mix_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", f"text {i}", "p") for i in range(100)], "doc_id long, source string, mix_slot string, place string")
    got = mixing.in_order(df).collect()
    assert {(r.doc_id, r.mix_slot, r.place) for r in got} == {(i, f"text {i}", "p") for i in range(100)}
    assert {r.place for r in mixing.mixed(df).collect()} == {"p"} and dict(mixing.mixed(df).dtypes)["mix_slot"] == "bigint"


def test_mix_is_whole_and_on_target(spark):
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = frame(spark, rows)
    w = {"hot": 4, "s0": 3, "s1": 1, "s2": 1, "s3": 1, "s4": 1}
    got = mixing.mixed(docs, w, block=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and len({(r.mix_slot, r.mix_place) for r in got}) == 3000
    ends = min(max(r.mix_slot for r in got if r.source == s) for s in w)
    for t in range(1, ends, 7):
        c = Counter({(r.source, r.mix_block) for r in got if r.mix_slot < t})
        n = Counter(s for s, _ in c)
        assert all(abs(n[s] - t * w[s] / sum(w.values())) < 1 for s in w)
    ordered = mixing.in_order(docs, w)
    assert ordered.columns == docs.columns and ordered.count() == 3000


def test_slots_follow_the_exact_targets():
    """The deviation from the targets themselves stays below a block however long the schedule is."""
    weights = mixing.tempered({None: 5_000_000} | {f"s{i}": 500_000 + i for i in range(19)} | {"rare": 7})
    blocks = {s: int(40_000 * w / sum(weights.values())) + 1 for s, w in weights.items()}
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    seen = Counter()
    for n, (s, j, t) in enumerate(mixing.slots_of(weights, blocks)):
        assert seen[s] == j
        seen[s] += 1
        if any(seen[x] == blocks[x] for x in ("rare", None, "s0")):
            break
        if n % 97 == 0:
            assert t == n and all(abs(seen[x] - (t + 1) * w / total) < 1 for x, w in exact.items())
    assert n > 20_000
    rare = [t for s, _, t in mixing.slots_of({"a": 9999, "b": 1}, {"a": 99_990, "b": 10}) if s == "b"]
    assert [t // 10_000 for t in rare] == list(range(10))


def test_mix_odd_inputs(odd, none):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(odd_rows()) and len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
    assert mixing.mixed(none).count() == 0 and mixing.in_order(none).count() == 0


# ------------------------------------------------------------------ 7


def spans_py(t):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    a += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    a += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(a)


def test_secret_base_spans():
    r = random.Random(5)
    atoms = ["password", "Token", ": ", "=", '"', "'", " ", "abcdefgh1", "é", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "\n", "api_key", "apikey", "x", "ſecret", "secret"]
    for _ in range(3000):
        t = "".join(r.choice(atoms) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(t) == spans_py(t), t


def test_lexer_passes_constants_on():
    t = 'BLOB = "Zx81kq0Pw2mN"\nname = "hello world"\nalias = BLOB\ndb_passphrase = alias\nclientCredential: \'qW3rTy77uIoP\'\nsize = "Zx81kq0Pw2mM"\npwd = "changeme-please"'
    found = [t[a:b] for a, b in secrets.lexed(t)]
    assert found == ["Zx81kq0Pw2mN", "qW3rTy77uIoP"]
    assert secrets.redacted(t).count("[SECRET]") == 2 and "hello world" in secrets.redacted(t)
    assert secrets.lexed("It was late: the passphrase was a word. See https://x.org/token") == []


A, B = "Zx81kq0Pw2mN", "qW3rTy77uIoP"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f'password_part = "{A}" + \\\n    "{B}"', [A, B]),
        (f'auth_token = (\n    "{A}"  # first half\n    f"{B}"\n)', [A, B]),
        (f'client_secret: str = """{A}"""', [A]),
        (f'db_passphrase = VALUE\nVALUE = "{A}"', [A]),  # defined after its use
        (f'x = "{A}"\ny = x\nx = "nothing here"\nprivate_token = y', [A]),
        (f'x = "{A}"\nx = "{B}"\nprivate_token = x', [B]),  # the nearest definition
        (f'# x = "{A}"\nprivate_token = x\nx = "{B}"', [B]),  # a comment defines nothing
        (f'credentials:\n  value: {A}\nother:\n  value: {B}', [A]),
        (f'{{"credentials": {{"value": "{A}"}}, "other": {{"value": "{B}"}}}}', [A]),
        (f'signing_secret: |\n  {A}\n  {B}\nname: x', [A, B]),
        (f"Authorization: Bearer {A}{B}", [A + B]),
        (f'export BASE={A}\nexport ENCRYPTION_PASSWORD="${{BASE}}{B}"', [A, B]),
        (f"settings['client_secret'] = '{A}'", [A]),
        (f'config.dbPwd := `{A}`', [A]),
        (f'private_token = loop\nloop = private_token\nname = "{A}"', []),
        (f'title = "{A}"\nurl: https://example.org/{B}', []),
        (f'access_token = os.environ["{A}"]', []),
    ],
)
def test_lexer_reads_syntax(text, want):
    assert [text[a:b] for a, b in secrets.lexed(text)] == want


def test_lexer_matches_an_evaluator():
    """Random programs of definitions in any order, evaluated from their structure and not from their text."""
    r = random.Random(9)
    for _ in range(400):
        n = r.randint(1, 9)
        names = [r.choice(["alpha", "beta", "gamma", "delta", "db_password", "clientSecret", "auth_token"]) for _ in range(n)]
        program = []
        for k in range(n):
            parts = [r.choice([("lit", "".join(r.choice("abcXYZ019/+") for _ in range(r.randint(2, 14)))), ("name", r.choice(names))]) for _ in range(r.randint(1, 3))]
            program.append((names[k], parts))
        text, at = "", {}
        for k, (name, parts) in enumerate(program):
            text += name + r.choice([" = ", "=", ": "])
            for i, (kind, v) in enumerate(parts):
                text += r.choice([" + ", "+"]) if i else ""
                quote = kind == "lit"
                at[k, i] = (len(text) + quote, len(text) + quote + len(v))
                text += f'"{v}"' if kind == "lit" else v
            text += "\n"

        def flat(k, seen, program=program):
            out = []
            for i, (kind, v) in enumerate(program[k][1]):
                if kind == "lit":
                    out.append((k, i))
                    continue
                before = [j for j in range(k) if program[j][0] == v]
                after = [j for j in range(len(program)) if program[j][0] == v and j != k]
                d = before[-1] if before else after[0] if after else None
                if d is None and len(program[k][1]) == 1 and (v != program[k][0]):
                    out.append((k, i))  # a bare word
                if d is not None and d not in seen:
                    seen.add(d)
                    out += flat(d, seen)
            return out

        want = set()
        for k in range(n):
            spans = list(dict.fromkeys(at[x] for x in flat(k, {k})))
            if spans and secrets.name_score(names[k]) * secrets.literal_score("".join(text[a:b] for a, b in spans)) >= 0.5:
                want |= set(spans)
        assert set(secrets.lexed(text)) == want, text


def test_lexer_is_linear_in_odd_texts():
    for t in ("a=" * 50_000, "key: " * 50_000, 'x = "' * 20_000, "a={" * 30_000, "password = (" * 20_000, "secret " * 100_000 + "= 1", "\n".join(f"a{i} = a{i - 1}" for i in range(20_000)) + "\nsecret = a19999"):
        secrets.lexed(t)


def test_secret_scan_odd_inputs(spark, odd, none):
    rows = [*odd_rows(), (50, 'é password = "hunter2hunter2" é', "en", "a")]
    for r in secrets.scan(frame(spark, rows)).collect():
        t = next(t for i, t, _, _ in rows if i == r.doc_id) or ""
        want = spans_py(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert set(secrets.joined(want).split(",")) <= set(r.spans.split(",")) | {""}
    assert secrets.scan(none).count() == 0
    clean = secrets.redact_documents(frame(spark, rows))
    assert clean.columns == odd.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert got[50].text == "é [SECRET]\" é" or "hunter2" not in got[50].text
    assert got[50].n_chars == len(got[50].text) and got[3].text == odd_rows()[3][1] and got[0].text is None


# ------------------------------------------------------------------ 8


def joined_py(rows, threshold=0.8):
    sets = [set(common.shingles(t).tolist()) for _, t, _, _ in rows]
    n, par = len(rows), list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                par[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return Counter((rows[i][0], least.get(find(i)), links[i]) for i in range(n))


def near_rows(n_groups, size, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, i = [], 100
    for g in range(n_groups):
        words = prose(r.randint(5, 120), seed + g, vocab).split()
        for _ in range(r.randint(1, size)):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w), "en", "a"))
            i += 1
    return rows


def as_counter(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_jaccard_join_matches_brute_force(spark, odd):
    rows = odd_rows() + near_rows(40, 12, 1)
    assert as_counter(jaccard.joined(frame(spark, rows))) == joined_py(rows)


def test_jaccard_join_with_null_ids(spark):
    """Exact and near copies without ids, beside copies with ids and among themselves."""
    vocab = [f"w{i}" for i in range(500)]
    a, b = prose(100, 31, vocab), prose(100, 32, vocab)
    texts = [(None, a), (7, a), (8, a + " more"), (None, a + " other"), (3, a + " other words"), (None, b), (None, b), (None, b + " more"), (None, b + " other")]
    rows = [(i, t, "en", "a") for i, t in texts] + near_rows(3, 5, 6)
    got = as_counter(jaccard.joined(frame(spark, rows)))
    assert got == joined_py(rows) and got[(7, 3, 4)] == 1


def test_jaccard_join_in_many_blocks(spark, monkeypatch):
    """Nodes, blocks and clusters that are too large take the way over deeper nodes and pairs of blocks."""
    for name, v in (("NODE", 8), ("BLOCK_SETS", 7), ("BLOCK_SHINGLES", 900), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard, name, v)
    monkeypatch.setattr(jaccard.loose_edges, "__defaults__", (8,))
    rows = near_rows(3, 60, 2)
    assert as_counter(jaccard.joined(frame(spark, rows))) == joined_py(rows)


def test_recall_of_a_run():
    """Pairs at the threshold meet in some run about as often as runs_for says."""
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 32, (4000, jaccard.PLACES), dtype=np.uint64).astype(np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 1 << 32, a.shape, dtype=np.uint64).astype(np.uint32))
    met = np.zeros(len(a), bool)
    pa_, pb = list(jaccard.paths(a, 6)), list(jaccard.paths(b, 6))
    for (ra, na), (rb, nb) in zip(pa_, pb):
        x, y = np.zeros(len(a), np.uint64), np.ones(len(a), np.uint64)
        x[ra], y[rb] = na[0], nb[0]
        met |= x == y
    assert met.mean() > 0.995 and jaccard.runs_for(0.9999, 0.8) >= 7


@pytest.mark.parametrize("gain", [1.0, 1e9])
def test_recall_in_large_nodes(spark, monkeypatch, gain):
    """Pairs whose nodes are all too large are met as often as others, in blocks as well as at the deepest level."""
    monkeypatch.setattr(jaccard, "GAIN", gain, raising=False)
    r = np.random.default_rng(11)
    n = 8000
    a = r.integers(0, 1 << 32, (n, jaccard.PLACES), dtype=np.uint64).astype("<u4")
    b = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 1 << 32, a.shape, dtype=np.uint64).astype("<u4"))
    sets = spark.createDataFrame([(2 * i + k, x[i].tobytes()) for i in range(n) for k, x in enumerate((a, b))], "fp long, sig binary")
    got = {(x.a, x.b) for x in jaccard.loose_edges(sets, jaccard.runs_for(0.9999, 0.8), 1).collect()}
    assert sum((2 * i, 2 * i + 1) not in got for i in range(n)) <= 5  # 0.8 are expected; a place a level would lose 50


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.v: r.label for r in jaccard.components(e).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


def test_one_of_each_with_clashing_columns(spark):
    t = prose(60, 3)
    df = spark.createDataFrame([(1, t, "x", 1), (2, t, "y", 2), (1, t, "x", 1), (3, "other words", "z", 3)], "doc_id long, text string, key string, d int").withColumnRenamed("d", "_dup_id")
    got = sorted((r.doc_id, r.key, r._dup_id) for r in jaccard.one_of_each(df).collect())
    assert got == [(1, "x", 1), (3, "z", 3)]


def test_one_of_each(spark, none):
    rows = odd_rows() + near_rows(10, 6, 4)
    want = {c for _, c, _ in joined_py(rows)}
    kept = jaccard.one_of_each(frame(spark, rows))
    assert kept.columns == none.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter({i: 1 for i in want})
    assert jaccard.joined(none).count() == 0 and jaccard.one_of_each(none).count() == 0


# ------------------------------------------------------------------ 9


def test_fingerprints_match_plain_code(spark, none):
    rows = [(i, prose(20 + i % 40, i), "en", "a") for i in range(57)] + [r for r in odd_rows() if r[0] not in range(57)]
    for parts in (1, 5, 40):
        got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows), parts).collect()}
        order = sorted(rows, key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
        for j, (i, t, _, _) in enumerate(order):
            t, nxt = t or "", order[(j + 1) % len(order)][1] or ""
            half = len(t) // 2
            e = t[: len(t) - half] + nxt[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            sig = [fingerprint.signature(x) for x in (t, e, nxt)]
            assert (r.fingerprint, r.edited_fingerprint) == tuple(map(fingerprint.as_hex, sig[:2]))
            assert (r.near_edited, r.near_next) == tuple(float((sig[0] == s).mean()) for s in sig[1:])
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(frame(spark, rows[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_fingerprints_with_ids_beyond_doubles(spark):
    base = (1 << 62) + 12345
    rows = [(base + 3 * i, prose(15, i), "en", "a") for i in range(40)] + [(-base - i, prose(15, 99 + i), "en", "a") for i in range(9)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows), 7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for j, (i, t, _, _) in enumerate(order):
        nxt = order[(j + 1) % len(order)][1]
        assert got[i].edited_sha256 == hashlib.sha256(fingerprint.edited(t, nxt).encode()).hexdigest()


def test_fingerprints_of_repeated_rows(spark, odd):
    assert fingerprint.fingerprints(odd, 4).count() == len(odd_rows())


def test_minhash_estimates_jaccard():
    vocab = [f"w{i}" for i in range(900)]
    a = prose(400, 1, vocab).split()
    for n in (20, 80, 200):
        b = a[:-n] + prose(n, 2, vocab).split()
        s, t = (common.shingles(" ".join(x)) for x in (a, b))
        true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        u = common.universal(512, 1)
        assert abs((common.minhash(s, *u) == common.minhash(t, *u)).mean() - true) < 0.08


def test_band_join_matches_brute_force(spark, odd, none):
    """Classes and exact numbers of links; a pair at the threshold is missed with a chance of 0.0002."""
    rows = odd_rows() + near_rows(40, 12, 1) + [(None, odd_rows()[3][1] + " more", "en", "a"), (None, None, "en", "a")]
    assert as_counter(fingerprint.near_classes(frame(spark, rows))) == joined_py(rows)
    assert fingerprint.near_classes(none).count() == 0
    want = joined_py(rows)
    got = fingerprint.with_classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    plain = {(r.doc_id, r.fingerprint, r.edited_sha256) for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert plain == {(r.doc_id, r.fingerprint, r.edited_sha256) for r in got}


def test_band_join_in_blocks(spark, monkeypatch):
    for name, v in (("NODE", 8), ("BLOCK_SETS", 7), ("BLOCK_SHINGLES", 900)):
        monkeypatch.setattr(jaccard, name, v)
    rows = near_rows(3, 60, 2)
    assert as_counter(fingerprint.near_classes(frame(spark, rows))) == joined_py(rows)


def test_band_recall_against_brute_force():
    """Links that share a band, of all links of at least the threshold."""
    rows = near_rows(150, 8, 9)
    sets = [common.shingles(t) for _, t, _, _ in rows]
    sig = [fingerprint.signature(t).astype("<u2").reshape(fingerprint.BANDS, -1) for _, t, _, _ in rows]
    met = links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                met += bool((sig[i] == sig[j]).all(axis=1).any()) and float((sig[i] == sig[j]).mean()) >= jaccard.LOOSE
    assert links > 300 and met >= 0.98 * links


def test_sieve_loses_nothing(spark):
    keys = spark.range(0, 3000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(0, 200_000).select("id", F.xxhash64("id").alias("key"))
    left = [r.id for r in jaccard.sieved(rows, keys).collect()]
    assert set(range(3000)) <= set(left) and len(left) < 10_000
    assert jaccard.sieved(rows, keys.limit(0)).count() == 0
    full = spark.range(0, jaccard.SIEVE).select(F.col("id").alias("word"), F.lit(-1).cast("long").alias("bits"))
    assert jaccard.sieve(rows.unionByName(rows)).count() <= jaccard.SIEVE and full.count() == jaccard.SIEVE


def test_shingles_in_slices(monkeypatch):
    t = prose(3000, 8) + " é日本 " + "x" * 500
    want = common.word_hashes(t)
    assert len(want) == 3000 + 2
    monkeypatch.setattr(common, "_SLICE", 100)
    assert (common.word_hashes(t) == want).all()
    assert len(common.shingles("")) == 0 and len(common.shingles("a b")) == 1 and len(common.shingles("a b c d e f")) == 2


# ------------------------------------------------------------------ 10


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    got = tokenfile.round_trip(odd, BPE, 2, f"file://{tmp_path}/ids").collect()
    assert len(got) == len(odd_rows())
    start = 0
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t, _, _) in zip(sorted(got, key=lambda r: r.start), rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(none, BPE, 2).count() == 0


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    enc = tokenfile.Encoder(BPE)
    r = random.Random(6)
    chars = [chr(i) for i in range(1, 256)] + [" ", "\n"] * 40 + list("'stremvld") * 4 + ["日", "😀", "<|endoftext|>", " "]
    ts = ["".join(r.choice(chars) for _ in range(50)) for _ in range(1500)] + ["", "\n\n a"]
    assert [x.tolist() for x in enc.encode(ts)] == [tok.encode(t, add_special_tokens=False).ids for t in ts]


def test_reader_opens_only_what_it_needs():
    f = io.BytesIO()
    w = tokenfile.Writer(f, frame_ids=50)
    docs = [(i // 2 * 3, np.arange(i, i + 20, dtype=np.uint32)) for i in range(40)]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = tokenfile.Reader(f, f.tell())
    assert len(r.frames) == 14
    assert [(d, x.tolist()) for d, x in r] == [(d, x.tolist()) for d, x in docs]
    r.opened = 0
    assert [x.tolist() for x in r.get(30)] == [x.tolist() for d, x in docs if d == 30] and r.opened <= 3
    assert r.get(31) == []
    import zstandard

    f.seek(0)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.getvalue()), read_across_frames=True).read()
    assert len(plain) == sum(x[2] for x in r.frames)  # other readers skip the index and the table
    bad = bytearray(f.getvalue())
    bad[-20] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.Reader(io.BytesIO(bad), len(bad)))


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_docs()
    rows += [(1000 + i, t, "en", "b") for i, (_, t, _, _) in enumerate(rows[1:20])] + [(2000, 'see password = "hunter2hunter2"', "en", "c"), (2001, None, "en", "c")]
    d = f"{tmp_path}/sf"
    spark.createDataFrame([r[:4] + (len(r[1] or ""),) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing", "sentencepiece"]
    bad = {i for i, _, t in labels if t}
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "sentencepiece" or docs.columns == before.columns
        after[name] = docs
    clean = [r for r in rows if r[0] not in bad and not re.search("scoundrel|villain", r[1] or "")]
    assert {r.doc_id for r in after["toxicity"].collect()} == {r[0] for r in clean}
    assert {r.doc_id for r in after["ngram_jaccard_join"].collect()} == {c for _, c, _ in joined_py(clean)}
    assert after["source_mixing"].count() == after["secret_scans"].count() == after["ngram_jaccard_join"].count() == docs.count()
    assert "hunter2" not in "".join(r.text or "" for r in after["secret_scans"].collect())
    assert docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, d).count() == docs.count()


def test_pipeline_odd_inputs(spark, tmp_path, none):
    """Empty tables; nulls, repeated rows, a very long text, and columns with the names that the operators use."""
    import corpus_pipeline

    e = f"{tmp_path}/empty"
    none.write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{e}/labels.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0
    rows = odd_rows()
    d = f"{tmp_path}/odd"
    extra = "position mix_slot mix_place _dup_id sha doc slot".split()
    frame(spark, rows).select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in extra]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.columns
        stage(spark, docs, d).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        assert docs.columns == before
    kept = {c for _, c, _ in joined_py(rows)}
    got = docs.collect()
    assert Counter(r.doc_id for r in got) == Counter(kept)
    assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in got for c in extra)
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(r.doc_id for r in out) == Counter(kept) and all(r.round_trip for r in out)


def test_pipeline_rows_come_in_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(30 if i % 50 else 8000, i, [f"w{k}" for k in range(900)]), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    d = f"{tmp_path}/sf"
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    want = sorted(mixing.mixed(frame(spark, rows).select("doc_id", "source")).collect(), key=lambda r: (r.mix_slot, r.mix_place))
    assert max(len(t) for _, t, _, _ in rows) >= pieces.CHUNK
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert all(a.position < b.position for a, b in zip(got, got[1:]))


def test_registered_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_shared_folder_comes_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert common.written(spark.range(3).withColumn("x", F.lit(1)), "t").count() == 3
