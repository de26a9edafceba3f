"""Benchmark items without an id count as in the SQL of operator 7."""

import duckdb

from strandlake.llm import decontaminate
from strandlake.llm.queries import oracle_sql


def test_items_without_an_id(spark, tmp_path):
    one, two = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    spark.createDataFrame([(1, f"x {one} y"), (2, f"{one} {two}"), (3, two), (4, "clean"), (5, "short item")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, one), (7, two), (None, two), (None, "short item")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op7_decontamination']}) ORDER BY doc_id").fetchall()
    got = decontaminate.op7_decontamination(spark, str(tmp_path)).select(*columns).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert [r["contaminated"] for r in got] == [True, True, True, False, True]
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [4]
