"""Graph operators against plain-Python dictionary code, and the pipeline on tiled reads."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import cleaning, graph, iterate, kmers, local, mercy, unitigs
from seqgraph.operators.mapping import map_reads
from seqgraph.plans.assembly import assembly
from seqgraph.plans.options import Options

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(FLIP)


def dna(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def as_reads(spark, seqs):
    return spark.createDataFrame([(i, 0, 0, s, len(s)) for i, s in enumerate(seqs)], "read_id long, lib_id int, mate int, seq string, len int")


def tiled(genome, length=60, step=5):
    out = [genome[i : i + length] for i in range(0, len(genome) - length + 1, step)]
    return out + [rc(s) for s in out]


def count_py(seqs, size):
    c = Counter()
    for s in seqs:
        for i in range(len(s) - size + 1):
            m = s[i : i + size]
            c[min(m, rc(m))] += 1
    return c


def unitigs_py(edges, k):
    """Maximal simple paths and loops by walking, as canonical strings (loops: as sets of canonical edges)."""
    d = set()
    for e in edges:
        d |= {e, rc(e)}
    out, inn = {}, {}
    for e in d:
        out.setdefault(e[:-1], []).append(e)
        inn.setdefault(e[1:], []).append(e)
    nxt = {e: out[e[1:]][0] for e in d if len(out.get(e[1:], [])) == 1 and len(inn[e[1:]]) == 1}
    has_prev = set(nxt.values())
    seen, lin = set(), set()
    for e in d:
        if e not in has_prev:
            path = [e]
            while path[-1] in nxt:
                path.append(nxt[path[-1]])
            seen |= set(path)
            s = path[0] + "".join(p[-1] for p in path[1:])
            lin.add(min(s, rc(s)))
    loops = set()
    for e in d - seen:
        ring, x = [e], nxt[e]
        while x != e:
            ring.append(x)
            x = nxt[x]
        loops.add(frozenset(min(r, rc(r)) for r in ring))
    return lin, loops


@pytest.fixture(scope="module")
def noisy(spark):
    g = dna(400, 1)
    ring = dna(70, 2)
    seqs = tiled(g) + [(ring * 3)[i : i + 60] for i in range(0, 70, 3)] * 2
    r = random.Random(3)
    for _ in range(30):
        s = list(g[(a := r.randrange(300)) : a + 60])
        s[r.randrange(60)] = r.choice("ACGT")
        seqs += ["".join(s)] * 2
    return seqs


def test_count_matches_dictionary(spark, noisy):
    got = {r.edge: r.mult for r in kmers.count_edges(as_reads(spark, [*noisy, "ACG", ""]), 15).collect()}
    assert got == dict(count_py(noisy, 16))


def test_long_sequence_is_cut_without_loss(spark):
    s = dna(3500, 9)
    assert {r.edge: r.mult for r in kmers.count_edges(as_reads(spark, [s]), 21).collect()} == dict(count_py([s], 22))
    assert sorted((r.pos, r.kmer) for r in kmers.enumerate_kmers(as_reads(spark, [s]), 21).collect()) == [(i, s[i : i + 21]) for i in range(len(s) - 20)]


def test_counts_saturate_and_palindromes_stand_once(spark):
    one = as_reads(spark, ["ACGTACGTACGTACGT"]).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(70000))))
    e = kmers.count_edges(one, 15)
    assert [r.mult for r in e.collect()] == [65535]
    assert graph.directed(e).count() == 1


def test_multiplicity_is_the_greatest_of_the_sources(spark):
    a, b = (spark.createDataFrame([("ACGTTGCAACGTTGCC", m)], "seq string, mult int") for m in (3, 7))
    assert [r.mult for r in graph.merge_sources([a, b], 15).collect()] == [7]


def test_unitigs_match_walking(spark, noisy):
    k = 15
    solid = kmers.solid_edges(as_reads(spark, noisy), k, 2)
    u = unitigs.build(graph.directed(solid), k).collect()
    lin, loops = unitigs_py([r.edge for r in solid.collect()], k)
    assert {min(r.seq, rc(r.seq)) for r in u if not r.is_loop} == lin
    assert sum(not r.is_loop for r in u) == len(lin)
    assert {frozenset(min(m, rc(m)) for m in (r.seq[i : i + k + 1] for i in range(r.length))) for r in u if r.is_loop} == loops
    counts = count_py(noisy, k + 1)
    for r in u:
        assert r.length == len(r.seq) - k
        assert r.total_depth == sum(counts[min(m, rc(m))] for m in (r.seq[i : i + k + 1] for i in range(r.length)))


def test_refresh_merges_what_a_removal_leaves(spark, noisy):
    k = 15
    solid = kmers.solid_edges(as_reads(spark, noisy), k, 2)
    u = unitigs.build(graph.directed(solid), k)
    gone = u.where("length < 10 AND NOT is_loop").select("uid", "seq").collect()
    v = unitigs.refresh(u, k, spark.createDataFrame([(r.uid,) for r in gone], "uid string")).collect()
    lost = {min(m, rc(m)) for r in gone for m in (r.seq[i : i + k + 1] for i in range(len(r.seq) - k))}
    lin, _ = unitigs_py([r.edge for r in solid.collect() if r.edge not in lost], k)
    assert {min(r.seq, rc(r.seq)) for r in v if not r.is_loop} == lin
    assert sum(r.total_depth for r in v) == u.agg(F.sum("total_depth")).first()[0] - sum(kmers_depth(solid, lost))


def kmers_depth(solid, lost):
    return [r.mult for r in solid.collect() if r.edge in lost]


def unitig_rows(spark, rows, k):
    """(seq, depth per edge) as unitigs."""
    df = spark.createDataFrame([(s, len(s) - k, int(d * (len(s) - k))) for s, d in rows], "seq string, length long, total_depth long")
    df = df.withColumn("is_loop", F.lit(False)).withColumn("is_palindrome", F.lit(False)).withColumn("is_changed", F.lit(False))
    return unitigs._named(df, k)


def bubble(spark, d1, d2, k=15):
    left, right = dna(60, 11), dna(60, 12)
    mid1, mid2 = "A" + dna(k - 2, 13) + "C", "G" + dna(k - 2, 13) + "C"
    a, b = left[-k:], right[:k]
    rows = [(left, 20), (right, 20), (a + mid1[:1] + b, d1), (a + mid2[:1] + b, d2)]
    return unitig_rows(spark, rows, k), rows


def test_bubble_keeps_the_deeper_branch(spark):
    u, rows = bubble(spark, 10, 4)
    kept = []
    v, n = cleaning.pop_bubbles(u, 15, careful=kept)
    assert n == 1
    seqs = [r.seq for r in v.collect()]
    assert len(seqs) == 1 and len(seqs[0]) == 60 + 60 + 1
    assert {min(r.seq, rc(r.seq)) for r in kept[0].collect()} == {min(s, rc(s)) for s, d in rows if d != 10}


def test_shallow_branch_is_not_kept_aside(spark):
    u, _ = bubble(spark, 10, 1)
    kept = []
    _, n = cleaning.pop_bubbles(u, 15, careful=kept)
    assert n == 1 and kept[0].count() == 0


def test_weak_link_ratio_is_inclusive(spark):
    k = 15
    left = dna(60, 21)
    a = left[-k:]
    u = unitig_rows(spark, [(left, 10), (a + "A" + dna(40, 22), 9), (a + "C" + dna(40, 23), 1)], k)
    w = cleaning.weak_links(u, k, 0.1).join(u, "uid").collect()
    assert len(w) == 1 and w[0].total_depth == w[0].length
    assert cleaning.weak_links(u, k, 0.09).count() == 0
    v, n = cleaning.disconnect_weak_links(u, k, 0.1)
    assert n == 1 and sorted(len(r.seq) for r in v.collect()) == [k + 40, 60 + 41]


def test_tip_needs_a_neighbour_more_than_eight_times_as_deep(spark):
    k = 15
    main, tip = dna(80, 31), None
    tip = main[30 : 30 + k] + ("A" if main[30 + k] != "A" else "C")
    for deep, gone in ((8, False), (9, True)):
        u = unitig_rows(spark, [(main[: 30 + k], deep), (main[30:], deep), (tip, 1)], k)
        near = unitig_rows(spark, [(main[: 30 + k], deep), (tip, 1)], k)
        assert (cleaning.unitig_tips(near, k, 2).count() == 1) is gone
        assert u.count() == 3


def test_local_low_depth(spark):
    k = 15
    main = dna(90, 41)
    tip = main[40 : 40 + k] + ("A" if main[40 + k] != "A" else "C") + dna(5, 42)
    u = unitig_rows(spark, [(main[: 40 + k], 50), (main[40:], 50), (tip, 2)], k)
    v, n, on = cleaning.remove_local_low_depth(u, k, 3, 30, ratio=0.2)
    assert n == 1 and on and [len(r.seq) for r in v.collect()] == [90]
    assert cleaning.iterate_local_low_depth(u, k, 1.5, 30, ratio=0.2)[1] == 1


def mercy_py(seqs, solid, k):
    d = {x for e in solid for x in (e, rc(e))}
    src, dst = {e[:-1] for e in d}, {e[1:] for e in d}
    out = []
    for s in seqs:
        if len(s) < k + 2:
            continue
        last = -1
        for i in range(len(s) - k + 1):
            m = s[i : i + k]
            state = (m in dst) + 2 * (m in src)
            if state == 1:
                last = i
            elif state:
                if state == 2 and last >= 0:
                    out += [min(e, rc(e)) for e in (s[j : j + k + 1] for j in range(last, i))]
                last = -1
    return sorted(out)


def test_mercy_matches_walking(spark):
    g = dna(300, 51)
    seqs = [g[i : i + 60] for i in range(0, 60, 4)] + [g[i : i + 60] for i in range(130, 240, 4)] + [g[80:180]]
    reads, k = as_reads(spark, seqs), 15
    solid = kmers.solid_edges(reads, k, 2)
    got = sorted(r.edge for r in mercy.mercy_edges(reads, k, 2, candidates_only=False).collect())
    assert got == mercy_py(seqs, [r.edge for r in solid.collect()], k) and got
    assert sorted(r.edge for r in mercy.mercy_edges(reads, k, 2).collect()) == got
    filled = mercy.one_pass_mercy(reads, k, 2).collect()
    assert sorted(min(e, rc(e)) for e in (seqs[r.read_id][r.pos : r.pos + k + 1] for r in filled)) == got


def test_next_edges_cover_tiled_reads(spark):
    g = dna(200, 61)
    k, step = 15, 6
    contigs = spark.createDataFrame([("a", g[:100], 7.0), ("b", g[100 - k :], 7.0)], "contig_id string, seq string, multi double")  # they share a node
    reads = as_reads(spark, tiled(g))
    hits = iterate.read_hits(reads, iterate.flanks(contigs, k, step), k, step)
    exact = {(r.read_id, r.pos) for r in iterate.scanned(reads, hits, k).collect()}
    loose = {(r.read_id, r.pos) for r in iterate.covered(reads, hits, k).collect()}
    assert exact and exact <= loose
    e = iterate.next_edges(reads, contigs, k, step).collect()
    assert {r.edge for r in e} <= set(count_py([g], k + step + 1)) and {r.mult for r in e} == {7}
    assert {r.mult for r in iterate.next_edges(reads, contigs, k, step, literal=True).collect()} == {0}


def test_mapping_is_unique_and_tied_reads_have_none(spark):
    g = dna(500, 71)
    other = g[:100] + dna(200, 72) + g[:100]
    contigs = spark.createDataFrame([("a", g[150:]), ("b", other)], "contig_id string, seq string")
    read = g[200:300]
    bad = read[:50] + rc(read[50:51]) + read[51:]
    reads = as_reads(spark, [read, rc(read), bad, g[:100], dna(100, 73), g[100:200]])
    m = {r.read_id: r for r in map_reads(reads, contigs).collect()}
    assert (m[0].contig_id, m[0].contig_from, m[0].contig_to, m[0].strand, m[0].mismatch) == ("a", 50, 149, 0, 0)
    assert (m[1].contig_from, m[1].strand) == (50, 1) and m[2].mismatch == 1
    assert 3 not in m and 4 not in m


def test_small_graph_rebuilds_its_sequence():
    g = dna(300, 81)
    assert [min(s, rc(s)) for s in local.assemble_end(tiled(g), g[:100])] == [min(g, rc(g))]


def test_small_graph_pops_bubbles():
    """One branch of a base's difference goes, unless something leaves it; a ring back to the fork is no bubble."""
    g = dna(120, 82)
    for spur in (False, True):
        s = local.SmallGraph(11)
        for r in [g] * 3 + [g[:60] + rc(g[60]) + g[61:]]:
            s.insert(r)
        if spur:
            s.insert(g[50:60] + rc(g[60]) + g[61:66] + dna(30, 83), counted=False)
        s.drop_bubbles()
        assert (min(g, rc(g)) in s.unitigs()) == (not spur)
    ring = dna(40, 84)
    s = local.SmallGraph(11)
    s.insert(ring * 3 + dna(30, 85))
    before = set(s.unitigs())
    s.drop_bubbles()
    assert set(s.unitigs()) == before


def test_tiled_reads_give_back_the_genome(spark):
    g = dna(600, 91)
    reads = as_reads(spark, tiled(g, 80, 2))
    libs = spark.createDataFrame([(0, 0, 1000, 80, False, "se")], "lib_id int, begin_id long, end_id long, max_read_len int, is_paired boolean, description string")
    out = assembly(reads, libs, Options(k_list=(21, 29), local=False)).collect()
    assert len(out) == 1 and (out[0].seq in g or rc(out[0].seq) in g) and out[0].len > 560


def test_empty_and_hopeless_reads_give_nothing(spark):
    libs = spark.createDataFrame([(0, 0, 0, 0, False, "se")], "lib_id int, begin_id long, end_id long, max_read_len int, is_paired boolean, description string")
    assert assembly(as_reads(spark, []), libs, Options(k_list=(21,))).count() == 0
    assert assembly(as_reads(spark, [dna(100, 5)]), libs, Options(k_list=(21,))).count() == 0


def test_options_are_checked():
    for bad in ((20,), (13,), (21, 51), (), (257,)):
        with pytest.raises(ValueError):
            Options(k_list=bad)
    o = Options(min_count=1)
    assert o.one_pass and not o.mercy
    assert Options.preset("meta-large").min_count == 1
    assert Options.from_json(o.to_json()) == o
    assert Options.by_step(27, 127, 10).k_list == Options.preset("meta-large").k_list
    with pytest.raises(ValueError):
        Options.by_step(21, 41, 7)
    assert Options(prune_depth=-1, min_count=3).prune_depth == 3 and Options(bubble_level=9).bubble_level == 2
    assert Options().for_reads(100).k_list[-1] == 119
