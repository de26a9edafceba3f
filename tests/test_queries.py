"""Catalogue queries against the other engine, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", ["dice_topk", "project_partials", "medoids", "orf_eval", "average_precision", "bgc_class_union", "token_batches", "region_extract", "bgc_pool_pe", "ic_values"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = catalogue.queries()[name](spark, DATA).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and ((a == b) | (a.isna() & b.isna())).all().all()


def test_every_statement_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "s", "rank"]


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['strandlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'dice_topk' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_streamed_projection(spark, tmp_path):
    from strandlake.streaming.projection import project_stream

    s = spark.createDataFrame([(0, "domain", "a"), (1, "domain", "b")], "id long, kind string, feature string")
    placed = spark.createDataFrame([(0, "0", 1.0, 2.0), (1, "1", 3.0, 4.0)], "id long, path string, x double, y double")
    spark.createDataFrame([(9, None, "domain", "b")], "id long, is_validated boolean, kind string, feature string").write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("id long, is_validated boolean, kind string, feature string").parquet(f"{tmp_path}/in")
    run = project_stream(arriving, s, placed, placed.select("id").limit(0), 3, lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), f"{tmp_path}/c")
    run.processAllAvailable()
    run.stop()
    r = spark.read.parquet(f"{tmp_path}/out/0").first()
    assert (r["id"], r["leaf_path"], r["x"], r["novelty"]) == (9, "1", 3.0, None)
