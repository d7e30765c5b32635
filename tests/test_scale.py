"""What must not grow with the input: broadcasts, tasks' shares and repeated rows."""

import os
import re

import pytest

from seqgraph.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["g02_one_pass_graph", "i02_exact_scan", "i02_covered_places", "j02_flank_probe", "l02_map_reads", "l05_single_hits", "w03_one_pass_mercy", "w04_long_edges", "i03_next_edges", "a06_read_tips"])
def test_no_broadcast_of_a_size_taken_from_files(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_a_task_gets_no_more_than_its_share_of_a_table(spark, tmp_path):
    from seqgraph.sources import tables

    spark.range(200_000).selectExpr("id", "repeat(uuid(), 4) AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert tables.spread(df, size // 23).rdd.getNumPartitions() >= 23
    assert tables.spread(df).rdd.getNumPartitions() == 4


def test_packed_places_across_chunks(monkeypatch):
    """Canonical k-mers with the bases beside them, against plain code, with reads cut by the chunks of the work."""
    import random
    from collections import Counter

    import pyarrow as pa

    from seqgraph.operators import packed

    monkeypatch.setattr(packed, "CHUNK", 37)
    rand = random.Random(1)
    reads = ["".join(rand.choice("ACGT") for _ in range(rand.randint(1, 60))) for _ in range(50)] + ["ACGT" * 8]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for size in (6, 21, 22, 28):
        got, want = Counter(), Counter()
        for x in packed._with_sides(pa.chunked_array([pa.array(["A", *reads])]).chunk(0)[1:], size):
            got.update((m, v >> 3 & 7, v & 7) for m, v in zip(packed.letters(x >> 6, size).to_pylist(), x.tolist()))
        for s in reads:
            for i in range(len(s) - size + 1):
                m, b, a = s[i : i + size], s[i - 1] if i else "", s[i + size : i + size + 1]
                m, b, a = (rc(m), rc(a), rc(b)) if m > rc(m) else (m, b, a)
                want[m, "ACGT".index(b) + 1 if b else 0, "ACGT".index(a) + 1 if a else 0] += 1
        assert got == want


def test_packed_counts_equal_strings(spark):
    from seqgraph.operators import kmers, packed

    reads = registry.reads(spark, SF, "conversations")
    want = kmers.canonical_kmers(reads, 22).groupBy("edge").count()
    got = packed.counts(reads, 22)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cut_equals_substrings(spark):
    from pyspark.sql import functions as F

    from seqgraph.sources import tables

    text = "".join(chr(97 + i * 7 % 26) for i in range(5000))
    got = tables.cut(spark.createDataFrame([(text,)], "t string"), "t", F.lit(100), 50, 100).collect()
    assert sorted((r.i, r.seq) for r in got) == [(i, text[50 * i : 50 * i + 100]) for i in range(100)]


def test_folded_loops_against_plain_code(spark):
    import random

    from seqgraph.functions import seq as fs

    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rand = random.Random(2)
    made = ["".join(rand.choice("ACGT") for _ in range(rand.randint(0, 40))) for _ in range(60)]
    cases = [None, "", "AT", "ACGT", *made, *(s + rc(s) for s in made)]
    for k in (4, 5):
        want = []
        for s in cases:
            at = next((i for i in range(max(1, len(s) - k)) if s[i : i + k + 1] == rc(s[i : i + k + 1])), None) if s is not None else None
            want.append(s if at is None else s[at + 1 : at + 1 + len(s) // 2])
        col = fs.fold_palindrome_loop("s", k)
        assert "lambda" not in str(col)  # a lambda is interpreted place by place
        got = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string").select("i", col.alias("f")).collect()
        assert [r.f for r in sorted(got)] == want


def test_rules_do_not_pair_unitigs_with_a_common_node(spark, monkeypatch):
    """Of n unitigs into a node and n out of it, the rules need sums at the node, not n * n pairs."""
    from seqgraph.operators import cleaning, unitigs

    rows = [(f"u{i}", s, 2, d, False, False, False) for i, (s, d) in enumerate([("AACCG", 20), ("TACCG", 20), ("CCGAT", 40), ("CCGTT", 2)])]
    u = spark.createDataFrame(rows, "uid string, seq string, length long, total_depth long, is_loop boolean, is_palindrome boolean, is_changed boolean")
    pairs = unitigs.adjacency(u, 3).collect()
    for module in (unitigs, cleaning):
        monkeypatch.setattr(module, "adjacency", lambda *a: pytest.fail("pairs"), raising=False)
    got = {r.uid: (r.indeg, r.outdeg) for r in unitigs.degrees(u, 3).collect()}
    assert got == {x: (sum(p.uid == x and p.strand == 1 for p in pairs), sum(p.uid == x and p.strand == 0 for p in pairs)) for x in got}
    assert got["u0"][1] == 2 and got["u2"][0] == 2
    assert [(r.uid, r.strand) for r in cleaning.weak_links(u, 3, 0.1).collect()] == [("u3", 0)]
    assert {r.uid: r.mean for r in cleaning.local_depth(u, 3).collect()}["u0"] == 10.5
    assert [r.uid for r in cleaning.unitig_tips(u, 3, 9).collect()] == []


def test_rounds_of_chains_are_numbers_and_leave_out_what_has_ended(spark, monkeypatch):
    """Rounds used to carry names, unitigs of 100 bases, and every row of chains that had long ended."""
    from pyspark.sql import functions as F

    from seqgraph.operators import paths

    written, cut = [], paths.cut_lineage

    def seen(df, *a):
        out = cut(df, *a)
        written.append((out.columns, dict(out.dtypes), out.count()))
        return out

    monkeypatch.setattr(paths, "cut_lineage", seen)
    name = lambda x: F.format_string("a-long-name-%06d", x)
    n = spark.range(1064)  # 500 pairs, a chain of 40 and rings of 3 and 21 by falling names
    link = F.when(F.col("id") < 1000, F.when(F.col("id") % 2 == 1, F.col("id") - 1)).when(F.col("id") < 1040, F.when(F.col("id") > 1000, F.col("id") - 1)).when(F.col("id") < 1043, F.when(F.col("id") > 1040, F.col("id") - 1).otherwise(1042)).otherwise(F.when(F.col("id") > 1043, F.col("id") - 1).otherwise(1063))
    links = n.select(name(link).alias("a"), name(F.col("id")).alias("b")).where(link.isNotNull())
    got = {r.id: (r.head, r.rank, r.is_loop) for r in paths.chains(n.select(name(F.col("id")).alias("id")), links).collect()}
    label = lambda i: f"a-long-name-{i:06d}"
    want = {label(i): (label(i - i % 2), i % 2, False) for i in range(1000)}
    for first, end, loop in ((1000, 1040, False), (1040, 1043, True), (1043, 1064, True)):
        want |= {label(i): (label(first), i - first, loop) for i in range(first, end)}
    assert got == want
    rounds = [(kinds, rows) for columns, kinds, rows in written if "live" in columns]
    assert all(kinds["id"] == kinds["p"] == "bigint" for kinds, _ in rounds)
    assert rounds[0][1] == 1064 and [rows for _, rows in rounds[2:]] and max(rows for _, rows in rounds[2:]) <= 64


def test_tips_join_numbers_and_equal_strings(spark, monkeypatch):
    from seqgraph.operators import kmers, packed

    reads = registry.reads(spark, SF, "conversations")
    got = kmers.read_tips(reads, 21)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "code#" in plan and "edge#" not in plan  # occurrences are shuffled for the join
    rows = sorted(map(repr, got.collect()))
    monkeypatch.setattr(packed, "fits", lambda *a: False)
    assert rows == sorted(map(repr, kmers.read_tips(reads, 21).collect())) and rows


def broadcasts(df):
    """What is broadcast besides the libraries, which have a row each: the leaves of its plans."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search("[A-Za-z]|$", x).start() for x in lines]
    ends = (next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)) - 1 for i, x in enumerate(lines) if "BroadcastExchange" in x)
    assert any("SortMergeJoin" in x for x in lines)
    return [lines[i] for i in ends if "begin_id" not in lines[i]]


def test_insert_sizes_broadcast_a_row_for_each_library_only(spark):
    assert broadcasts(registry.queries()["l03_insert_sizes"](spark, SF)) == []


def test_what_a_local_range_sums_up_broadcasts_a_row_for_each_library_only(spark, monkeypatch):
    from seqgraph.operators import mapping

    seen = []
    monkeypatch.setattr(mapping, "insert_stats", lambda inserts, lib_id: seen.append(inserts) or (200.0, 10.0))
    assert registry.queries()["l04_local_range"](spark, SF).first()[0] == 230
    assert [broadcasts(x) for x in seen] == [[]]


def test_mate_hits_broadcast_a_row_for_each_library_only(spark):
    assert broadcasts(registry.queries()["l06_mate_hits"](spark, SF)) == []


def test_more_input_makes_more_buckets_and_not_larger_ones(spark, monkeypatch):
    from seqgraph.operators import kmers, packed

    reads = registry.reads(spark, SF, "conversations")
    want = sorted(map(repr, kmers.with_neighbours(reads, 22).groupBy("edge", "prev", "next").agg({"*": "count"}).collect()))
    few = packed._bits(reads)
    monkeypatch.setattr(packed, "BUCKET_BYTES", 16)
    assert packed._bits(reads) > few
    got = packed.flanked(reads, 22).withColumnRenamed("mult", "count(1)")
    assert sorted(map(repr, got.collect())) == want


@pytest.mark.parametrize("name", ["a12_min_depth", "f15_first_minimum", "g05_colex_order", "p04_directed_edges"])
def test_a_graph_that_is_read_once_is_not_written_first(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "cut_lineage", lambda *a: pytest.fail("written"))
    assert registry.queries()[name](spark, SF).count()
