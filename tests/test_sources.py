"""Files, libraries, contigs, statistics, reports, and counting on a stream."""

import bz2
import gzip
import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqgraph.functions import seq, stats
from seqgraph.operators import report
from seqgraph.operators.kmers import count_edges
from seqgraph.plans.assembly import Stages
from seqgraph.sources import fastx, tables
from seqgraph.streaming import kmers as stream

FASTA = ">a first one\nACGT\nAC\n>b\nNNACGTNNAC\r\n>c x\nNNNN\n>d\n\n>e\nacgu\n"
FASTQ = "@a first\nACGT\n+\n@@@@\n@b\nNNAC\n+b\n>>>>\n"
WANT = [("a", "first one", "ACGTAC"), ("b", "", "NNACGTNNAC"), ("c", "x", "NNNN"), ("d", "", ""), ("e", "", "acgu")]


def rows(df):
    return [(r.name, r.comment, r.seq) for r in df.orderBy("place").collect()]


@pytest.mark.parametrize("pack", [None, gzip, bz2])
def test_fasta(spark, tmp_path, pack):
    p = tmp_path / ("x.fa" + {None: "", gzip: ".gz", bz2: ".bz2"}[pack])
    p.write_bytes(FASTA.encode() if pack is None else pack.compress(FASTA.encode()))
    assert rows(fastx.scan(spark, str(p))) == WANT
    assert [r.seq for r in fastx.single(spark, str(p)).orderBy("n").collect()] == ["ACGTAC", "ACGT", "A", "A", "ACGG"]


def test_fastq_and_empty(spark, tmp_path):
    p, q = tmp_path / "x.fq", tmp_path / "empty.fa"
    p.write_text(FASTQ)
    q.write_text("")
    assert rows(fastx.scan(spark, str(p))) == [("a", "first", "ACGT"), ("b", "", "NNAC")]
    assert fastx.scan(spark, str(q)).count() == 0
    reads, libs = fastx.build_library(spark, [("se", str(q))])
    assert reads.count() == 0 and libs.first().end_id == 0


def test_libraries(spark, tmp_path):
    one, two, il = (tmp_path / n for n in ("1.fa", "2.fa", "il.fa"))
    one.write_text("".join(f">r{i}\n{'ACGT' * (i + 1)}\n" for i in range(5)))
    two.write_text("".join(f">r{i}\n{'TTGA' * (i + 1)}\n" for i in range(4)))
    il.write_text(">x\nAAC\n>y\nGGT\n")
    reads, libs = fastx.build_library(spark, [("pe", str(one), str(two)), ("interleaved", str(il)), ("se", str(one))])
    got = reads.orderBy("read_id").collect()
    assert [r.read_id for r in got] == list(range(15))
    assert [(r.seq[:4], r.mate) for r in got[:4]] == [("ACGT", 0), ("TTGA", 1), ("ACGT", 0), ("TTGA", 1)]
    assert [(r.begin_id, r.end_id, r.max_read_len, r.is_paired) for r in libs.orderBy("lib_id").collect()] == [(0, 8, 16, True), (8, 10, 3, True), (10, 15, 20, False)]
    assert [r.n_reads for r in fastx.library_metadata(reads).orderBy("lib_id").collect()] == [8, 2, 5]
    with pytest.raises(ValueError):
        fastx.build_library(spark, [("interleaved", str(one))])


def test_contigs_out_and_in(spark, tmp_path):
    c = spark.createDataFrame([("0", 21, 0, 2.5, 30, "ACGTA" * 6), ("1", 21, 3, 1.0, 40, "ACGTT" * 8), ("2", 21, 1, 7.25, 25, "CCGTA" * 5)], "contig_id string, k int, flag int, multi double, len int, seq string")
    tables.write_fasta(c, str(tmp_path / "c"), 21)
    back = tables.parse_contigs(fastx.scan(spark, str(tmp_path / "c" / "*.txt")))
    assert sorted((r.contig_id, r.k, r.flag, r.multi, r.len, r.seq) for r in back.collect()) == [(f"k21_{r.contig_id}", *tuple(r)[1:]) for r in c.collect()]
    assert [r.mult for r in tables.scan_contigs(c, 28).orderBy("contig_id").collect()] == [3, 1]
    assert [r.contig_id for r in tables.for_iterate(c).collect()] == ["0"]
    e = {r.contig_id: r for r in tables.extend_loops(c, 21, 29).collect()}
    assert e["1"].seq == "ACGTT" * 8 + ("ACGTT" * 8)[21:29] and e["0"].len == 30
    assert "1" not in {r.contig_id for r in tables.extend_loops(c, 21, 47).collect()}


def test_fastg_links(spark):
    r = random.Random(1)
    g = "".join(r.choice("ACGT") for _ in range(120))
    c = spark.createDataFrame([("a", g[:60], 2.0), ("b", seq_rc(g[39:]), 3.0)], "contig_id string, seq string, multi double")
    out = {x.record.split("\n")[0] for x in report.fastg(c, 21).collect()}
    linked = [h for h in out if ":" in h]
    assert len(out) == 4 and len(linked) == 2
    assert any("length_60" in h.split(":")[0] and h.split(":")[1].rstrip(";").endswith("'") for h in linked)


def seq_rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


DNA = st.text("ACGT", min_size=1, max_size=31)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(DNA, min_size=1, max_size=20))
def test_functions_on_any_sequences(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    n = F.length("s")
    got = df.select("s", seq.rc("s").alias("r"), seq.canonical("s").alias("c"), seq.is_palindrome("s").alias("p"), seq.append_base("s", F.lit("G")).alias("a"), seq.prepend_base("s", F.lit("T")).alias("b"), seq.base_at("s", 0).alias("x"), seq.set_base("s", n - 1, F.lit("C")).alias("y"), seq.mismatches("s", seq.rc("s")).alias("m"), seq.pack("s").alias("k")).collect()
    for r in got:
        t = seq_rc(r.s)
        assert (r.r, r.c, r.p, r.a, r.b, r.x, r.y) == (t, min(r.s, t), r.s == t, r.s[1:] + "G", "T" + r.s[:-1], r.s[0], r.s[:-1] + "C")
        assert r.m == sum(a != b for a, b in zip(r.s, t))
        assert r.k == int("".join(str("ACGT".index(c)) for c in r.s), 4)
    k = len(seqs[0])
    assert df.where(n == k).select(seq.unpack(seq.pack("s"), k).alias("u"), "s").where("u != s").count() == 0


def test_trim_fold_and_similarity(spark):
    df = spark.createDataFrame([("NNACGTNNAC",), ("acgtn",), ("NNN",)], "s string")
    assert [r[0] for r in df.select(seq.n_trim("s")).collect()] == ["ACGT", "ACGT", ""]
    half = "ACGGTCATTGCA"
    whole = half + seq_rc(half)
    folded = spark.createDataFrame([(whole,)], "s string").select(seq.fold_palindrome("s", 11)).first()[0]
    assert whole.startswith(folded) and len(folded) == (len(whole) - 11 - 1) // 2 + 12
    pairs = spark.createDataFrame([("ACGTACGTAC", "ACGTACGTAC"), ("ACGTACGTAC", "ACGTTCGTAC"), ("ACGTACGTAC", "ACG"), ("ACGTACGTAC", "TTTTACGTAC")], "a string, b string")
    assert [r[0] for r in pairs.select(seq.similar_enough("a", "b", 0.8)).collect()] == [True, True, False, False]
    assert [r[0] for r in pairs.select(seq.similar_enough("a", "b", 0.95)).collect()] == [False] * 4  # no edit is allowed: band below one


@pytest.fixture(scope="module")
def values():
    r = random.Random(2)
    return [int(r.expovariate(0.05)) + 1 for _ in range(500)]


def test_statistics(spark, values):
    h = stats.histogram(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    s = stats.summary(h).first()
    assert (s.n, s.least, s.greatest, s.total, s["mean"]) == (500, min(values), max(values), sum(values), sum(values) // 500)
    assert abs(s.sd - statistics.pstdev(values)) < 1e-6
    v = sorted(values)
    assert stats.percentile(h, 0.3).first()[0] == v[150]
    c, n50 = 0, None
    for x in reversed(v):
        c += x
        if c >= sum(v) / 2:
            n50 = x
            break
    assert stats.nx(h).first()[0] == n50
    c = {x: v.count(x) for x in v}
    low = {x for x in c if sum(c[y] for y in c if y <= x) <= 25}
    high = {x for x in c if sum(c[y] for y in c if y >= x) <= 25}
    assert {x.value: x.n for x in stats.trim(h, 0.1).collect()} == {x: n for x, n in c.items() if x not in low | high}
    top = []
    for x in sorted(c, reverse=True):
        top += [x] * c[x]
        if len(top) > 125:
            break
    assert abs(stats.up_mean(h, 0.25).first()[0] - sum(top) / len(top)) < 1e-9
    assert stats.trim_low(h, 10).agg(F.min("value")).first()[0] >= 10
    lengths = spark.createDataFrame([(5,), (4,), (1,)], "len int")
    assert report.n50(lengths).first()[0] == 5


def test_min_depth(spark):
    counts = {1: 900, 2: 300, 3: 60, 4: 20, 5: 15, 6: 25, 7: 60, 8: 120, 9: 150, 10: 120, 11: 60, 12: 20}
    h = spark.createDataFrame(list(counts.items()), "value int, n long")
    assert stats.first_local_minimum(counts) == 5
    assert stats.first_local_minimum({1: 5, 2: 4, 3: 3}) == 0 and stats.first_local_minimum({}) == 0
    got = stats.infer_min_depth(h)
    assert got == pytest.approx(3, abs=0.2) and math.isclose(got * got, round(got * got), abs_tol=0.1)
    assert stats.infer_min_depth(h.where("value < 0")) == 0.0


def test_read_stats_of_nothing(spark):
    r = report.read_stats(spark.createDataFrame([], "seq string")).first()
    assert (r.n, r.total, r.longest, r.shortest, r.avg) == (0, 0, 0, 999_999_999, None)


def test_stages_are_not_run_twice(spark, tmp_path):
    ran = []

    def make():
        ran.append(1)
        return spark.range(3)

    for _ in range(2):
        assert Stages(spark, f"file://{tmp_path}/w").run("x", make).count() == 3
    assert len(ran) == 1


def test_stream_counts_like_batch(spark, tmp_path):
    r = random.Random(3)
    seqs = [("".join(r.choice("ACGT") for _ in range(40)),) for _ in range(30)]
    df = spark.createDataFrame([(i, 0, 0, s, 40) for i, (s,) in enumerate(seqs * 2)], stream.READ_SCHEMA)
    for i in range(3):
        df.where(F.col("read_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.keep_counts(stream.read_stream(spark, f"{tmp_path}/in", 1), 15, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {x.edge: x.mult for x in stream.latest_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {x.edge: x.mult for x in count_edges(df, 15).collect()}
