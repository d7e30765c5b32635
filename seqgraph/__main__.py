"""Command line: python -m seqgraph assemble | readstat | filterbylen | fastg."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from .operators import report
from .plans.assembly import assembly, saved_options
from .plans.options import PRESETS, Options
from .sources import fastx, tables

FLAGS = {bool: lambda x: x.lower() in ("1", "true", "yes"), int: int, float: float}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqgraph")
    jobs = top.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("assemble", help="contigs from reads")
    a.add_argument("--pe", nargs=2, action="append", default=[], metavar=("FIRST", "SECOND"), help="two files of mates")
    a.add_argument("--interleaved", action="append", default=[], metavar="FILE", help="a file with mates in turn; - is standard input")
    a.add_argument("--se", action="append", default=[], metavar="FILE", help="single reads; - is standard input")
    a.add_argument("--out", required=True, help="folder of the stages and of contigs.fa")
    a.add_argument("--continue", dest="resume", action="store_true", help="go on with the options that the folder was begun with")
    a.add_argument("--preset", choices=sorted(PRESETS))
    a.add_argument("--k-list", type=lambda x: tuple(int(k) for k in x.split(",")))
    a.add_argument("--k-min", type=int)
    a.add_argument("--k-max", type=int)
    a.add_argument("--k-step", type=int)
    for f in fields(Options):
        if f.name not in ("k_list", "extra"):
            a.add_argument(f"--{f.name.replace('_', '-')}", type=FLAGS[type(f.default)], help=f"default: {f.default}")
    r = jobs.add_parser("readstat", help="number and lengths of reads")
    r.add_argument("file")
    b = jobs.add_parser("filterbylen", help="contigs of a length at least")
    b.add_argument("file")
    b.add_argument("--min-len", type=int, required=True)
    b.add_argument("--out")
    g = jobs.add_parser("fastg", help="contigs with their links")
    g.add_argument("file")
    g.add_argument("--k", type=int, required=True)
    g.add_argument("--out", required=True)
    return top


def options(args: argparse.Namespace) -> Options:
    """Options from the command line: a list of k, steps of k, a preset or the default."""
    given = {f.name: getattr(args, f.name) for f in fields(Options) if getattr(args, f.name, None) is not None}
    steps = [args.k_min, args.k_max, args.k_step]
    if any(x is not None for x in steps):
        if args.k_list or args.preset or None in steps:
            raise ValueError("k_min, k_max and k_step go together, without a list or a preset")
        return Options.by_step(*steps, **given)
    if "k_list" in given:
        given.setdefault("auto_k", False)
    return Options.preset(args.preset, **given) if args.preset else Options(**given)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqgraph").getOrCreate()
    if args.job == "assemble":
        opt = saved_options(spark, args.out) if args.resume else options(args)
        specs = [("pe", *x) for x in args.pe] + [("interleaved", x) for x in args.interleaved] + [("se", x) for x in args.se]
        if not specs:
            raise SystemExit("no reads are given")
        out = assembly(*fastx.build_library(spark, specs), opt, args.out)
        tables.write_fasta(out, f"{args.out}/contigs.fa", opt.k_list[-1])
        print(tables.contig_info(out).first().asDict())
    elif args.job == "readstat":
        print(report.read_stats(fastx.single(spark, args.file)).first().asDict())
    else:
        found = fastx.scan(spark, args.file)
        if args.job == "fastg":
            places = found.select("place", "name")
            report.write_fastg(tables.parse_contigs(found).join(places.withColumnRenamed("name", "contig_id"), "contig_id"), args.out, args.k)
        else:
            kept, stats = report.filter_by_length(tables.parse_contigs(found), args.min_len)
            if args.out:
                tables.write_fasta(kept, args.out, 0)
            print(stats.first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
