"""The command line, resumed runs and files of odd forms."""

import random

import pytest
from pyspark.sql import functions as F

from seqgraph.__main__ import main, options, parser
from seqgraph.operators import report
from seqgraph.plans.assembly import Stages, saved_options
from seqgraph.plans.options import Options
from seqgraph.sources import fastx


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def fasta(path, seqs):
    path.write_text("".join(f">s{i} x\n{s}\n" for i, s in enumerate(seqs)))
    return str(path)


def test_assemble_and_continue(spark, tmp_path, capsys):
    g = genome(400, 3)
    reads = fasta(tmp_path / "r.fa", [g[i : i + 80] for i in range(0, 321, 2)])
    out = str(tmp_path / "run")
    assert main(["assemble", "--se", reads, "--out", out, "--k-list", "21,29", "--local", "false"], spark) == 0
    first = capsys.readouterr().out
    assert "'n_contigs': 1" in first and saved_options(spark, out).k_list == (21, 29)
    assert main(["assemble", "--se", reads, "--out", out, "--continue"], spark) == 0
    assert capsys.readouterr().out == first
    with pytest.raises(ValueError, match="differs"):
        main(["assemble", "--se", reads, "--out", out, "--k-list", "21,31", "--local", "false"], spark)
    other = fasta(tmp_path / "other.fa", [g[:100]])
    with pytest.raises(ValueError, match="differs"):
        main(["assemble", "--se", other, "--out", out, "--continue"], spark)


def test_readstat_and_filterbylen(spark, tmp_path, capsys):
    path = fasta(tmp_path / "c.fa", ["ACGT" * 100, "ACGT" * 20])
    main(["readstat", path], spark)
    assert "'n': 2" in capsys.readouterr().out
    main(["filterbylen", path, "--min-len", "100", "--out", str(tmp_path / "kept")], spark)
    assert "'n_contigs': 1" in capsys.readouterr().out
    assert spark.read.text(str(tmp_path / "kept")).count() == 2


def test_options_of_the_command_line():
    o = options(parser().parse_args(["assemble", "--out", "x", "--k-min", "21", "--k-max", "41", "--k-step", "10", "--min-count", "3", "--mercy", "no"]))
    assert o == Options.by_step(21, 41, 10, min_count=3, mercy=False)
    assert options(parser().parse_args(["assemble", "--out", "x", "--preset", "meta-large"])) == Options.preset("meta-large")
    with pytest.raises(ValueError):
        options(parser().parse_args(["assemble", "--out", "x", "--k-min", "21"]))


def test_fastq_of_other_forms_is_an_error(spark, tmp_path):
    good = "@a x\nACGT\n+\nIIII\n@b\nGG\n+\nII\n\n"
    (tmp_path / "good.fq").write_text(good)
    assert [r.seq for r in fastx.scan(spark, str(tmp_path / "good.fq")).orderBy("place").collect()] == ["ACGT", "GG"]
    for name, text in {"multi": "@a\nACGT\nACGT\n+\nIIII\nIIII\n@b\nGG\n+\nII\n", "mixed": good.strip() + "\n>c\nACGT\n", "blank": "@a\nACGT\n+\nIIII\n\n@b\nGG\n+\nII\n", "cut": "@a\nACGT\n+\n"}.items():
        (tmp_path / f"{name}.fq").write_text(text)
        with pytest.raises(Exception, match="four lines a record"):
            fastx.scan(spark, str(tmp_path / f"{name}.fq")).collect()


def test_standard_input(spark, tmp_path, monkeypatch):
    (tmp_path / "in.fa").write_text(">a\nACGT\nAC\n>b\nGG\n")
    with open(tmp_path / "in.fa") as f:
        monkeypatch.setattr("sys.stdin", f)
        assert [r.seq for r in fastx.scan(spark, "-").orderBy("place").collect()] == ["ACGTAC", "GG"]


def test_fastg_is_numbered_in_the_order_of_the_file(spark, tmp_path, capsys):
    path = fasta(tmp_path / "c.fa", [genome(60 + i, i) for i in range(5)])
    main(["fastg", path, "--k", "21", "--out", str(tmp_path / "g")], spark)
    heads = [r.value for r in spark.read.text(str(tmp_path / "g")).where(F.col("value").startswith(">")).collect()]
    assert sorted(h.split("_cov")[0] for h in heads if "'" not in h) == [f">NODE_{i + 1}_length_{60 + i}" for i in range(5)]
    df = spark.createDataFrame([("b", "A" * 30, 1.0), ("a", "C" * 40, 1.0)], "contig_id string, seq string, multi double")
    assert {r.i: "_40_" in r.record for r in report.fastg(df, 21).where("strand = 0").collect()} == {1: True, 2: False}


def test_a_stage_that_is_complete_is_not_run_again(spark, tmp_path):
    s = Stages(spark, str(tmp_path / "x"))
    assert s.run("n", lambda: spark.range(3)).count() == 3
    assert s.run("n", lambda: spark.range(9)).count() == 3
