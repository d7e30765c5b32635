"""The whole assembly: reads to contigs over a rising list of k, resumable from Parquet stages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import canonical
from ..operators import cleaning, graph, iterate, kmers, local, mercy
from ..operators.joins import shuffled
from ..operators.paths import cut_lineage
from ..sources.tables import final_contigs, for_iterate, scan_contigs
from .options import Options


class Stages:
    """Results by name under a folder. A stage whose result is complete there is read, not run again."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, name: str) -> bool:
        if not self.folder:
            return False
        fs, p = self._fs(f"{self.folder}/{name}/_SUCCESS")
        return fs.exists(p)

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.folder:
            return cut_lineage(make())
        path = f"{self.folder}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def begin(self, opt: Options, libs: DataFrame) -> None:
        """Notes the options and the inputs of a new folder; those of one that has begun must be the same."""
        rows = [r.asDict() for r in libs.orderBy("lib_id").collect()]  # a row for each library
        for name, text in (("options.json", opt.to_json()), ("inputs.json", json.dumps(rows, indent=1, default=str))):
            if self.folder and self.done(name):
                found = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect()).rstrip("\n")
                if found != text:
                    raise ValueError(f"{self.folder}/{name} was written by a run that differs; continue with its own, or use another folder")
            else:
                self.note(name, text)

    def note(self, name: str, text: str) -> None:
        """A small text file, such as the options."""
        if self.folder:
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}")


def saved_options(spark: SparkSession, folder: str) -> Options:
    """The options that a run in the folder has begun with."""
    return Options.from_json(spark.read.text(f"{folder}/options.json", wholetext=True).first().value)


def first_graph(reads: DataFrame, k: int, opt: Options) -> DataFrame:
    """Solid edges of the first k, with mercy edges."""
    edges = kmers.solid_edges(reads, k, opt.min_count)
    if opt.mercy and opt.one_pass:
        at = mercy.one_pass_mercy(reads, k, opt.min_count).join(shuffled(reads.select("read_id", "seq")), "read_id")
        extra = at.select(canonical(F.substring("seq", F.col("pos") + 1, F.lit(k + 1))).alias("edge"))
        return graph.from_reads(reads, k, opt.min_count, extra)
    if opt.mercy:
        found = mercy.mercy_edges(reads, k, opt.min_count).distinct()
        edges = edges.unionByName(found).groupBy("edge").agg(F.max("mult").alias("mult"))
    return graph.directed(edges)


def assembly(reads: DataFrame, libs: DataFrame, opt: Options = Options(), folder: str | None = None) -> DataFrame:
    """Contigs of min_contig_len at least from reads and libs. Empty reads, or reads without a contig, give no rows."""
    spark = reads.sparkSession
    stages = Stages(spark, folder)
    longest = libs.agg(F.max("max_read_len")).first()[0] or 0
    opt = opt.for_reads(longest)
    stages.begin(opt, libs)
    ks = opt.k_list
    finals: list[DataFrame] = []
    edges: DataFrame | None = None
    contigs: DataFrame | None = None
    for i, k in enumerate(ks):
        last = i == len(ks) - 1
        if edges is None:
            dbg = stages.run(f"k{k}.graph", lambda k=k: first_graph(reads, k, opt))
        else:
            dbg = stages.run(f"k{k}.graph", lambda k=k, e=edges: graph.directed(graph.merge_sources([e], k)))
        if dbg.isEmpty():
            break
        got: dict[str, DataFrame] = {}
        names = ("contigs", "standalone", "addi", "bubbles")

        def assembled(name: str, dbg=dbg, k=k, got=got, last=last) -> DataFrame:
            if not got:
                got.update(cleaning.assemble(dbg, k, cleaning.AssembleOptions(
                    max_tip_len=opt.tip_len(k), min_depth=opt.prune_depth, cleaning_rounds=opt.cleaning_rounds, bubble_level=opt.bubble_level, merge_len=opt.merge_len, merge_similar=opt.merge_similar,
                    prune_level=opt.prune_level, disconnect_ratio=opt.disconnect_ratio, low_local_ratio=opt.low_local_ratio, careful_bubble=not last, is_final_round=last,
                    output_standalone=not opt.local, min_standalone=opt.min_standalone(),
                )))
            return got[name]

        parts = {n: stages.run(f"k{k}.{n}", lambda n=n: assembled(n)) for n in names}
        contigs = parts["contigs"]
        finals.append(parts["standalone"])
        if last:
            break
        nxt = ks[i + 1]
        sources = [scan_contigs(contigs, k_from=k, k_to=nxt).select("seq", "mult"), parts["bubbles"].select("seq", F.floor(F.col("multi") + 0.5).cast("int").alias("mult")), parts["addi"].select("seq", F.lit(1).alias("mult"))]
        if opt.local:
            loc = stages.run(f"k{k}.local", lambda c=contigs, k=k: local.local_assembly(reads, libs, c, kmax=k))
            sources.append(loc.select("seq", F.lit(1).alias("mult")))
        seeds = for_iterate(contigs).select("seq", "multi").unionByName(parts["bubbles"])
        more = stages.run(f"k{nxt}.edges", lambda s=seeds, k=k, n=nxt: iterate.next_edges(reads, s, k, n - k))
        sources.append(more.select(F.col("edge").alias("seq"), "mult"))
        edges = sources[0]
        for s in sources[1:]:
            edges = edges.unionByName(s)
    if contigs is None:
        return spark.createDataFrame([], "contig_id string, k int, flag int, multi double, len int, seq string")
    out = stages.run("final", lambda: final_contigs(finals, contigs, opt.min_contig_len))
    if folder:
        stages.note("done", json.dumps({"k_list": list(ks)}))
    return out
