"""Every registered query with SQL against DuckDB on the smallest tables, and the repository without its removable part."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark conversations labels events"

from seqgraph.plans import registry  # noqa: E402


def norm(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, (bool, str)) else v

    df = df[sorted(df.columns)]
    return [df.columns.tolist(), sorted(repr([one(v) for v in r]) for r in df.itertuples(index=False, name=None))]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert norm(got) == norm(db.sql(registry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_partitions_and_order_change_nothing(spark):
    """Edges and unitigs are the same whatever the shuffle partitions and the order of reads."""
    from pyspark.sql import functions as F

    from seqgraph.functions.seq import rc
    from seqgraph.operators import graph, kmers, unitigs

    reads = spark.createDataFrame([(i, s) for i, s in enumerate(["ACGTTGCATGCCATTGACCGTA", "TTGCATGCCATTGACCGTAACC", "GGCATGCCATTGACCGTAACCT"])], "read_id long, seq string")
    seen = []
    for n, df in ((2, reads), (7, reads.orderBy(F.desc("read_id"))), (3, reads.withColumn("seq", rc("seq")))):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        e = kmers.solid_edges(df, 15, 1)
        u = unitigs.build(graph.directed(e), 15)
        seen.append((sorted(map(tuple, e.collect())), sorted((r.uid, r.seq, r.total_depth) for r in u.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]


def test_without_the_removable_part(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", ".hypothesis")
    shutil.copytree(REPO, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_nothing_else_imports_the_removable_part():
    for p in (REPO / "seqgraph").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p
