"""Models: held-out accuracy on the small tables, and defined results of the awkward cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import langid, ordinal, quality, toxicity
from strandlake.llm.common import held_out, table
from tests.llm.corpus import documents

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@needs_data
def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    langs, protos = langid.learn(docs.filter(~held_out(F.col("doc_id"))))
    got = langid.predict(docs, langs, protos).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


def test_language_of_awkward_rows(spark):
    df = documents(spark)
    langs, protos = langid.learn(df)
    got = langid.predict(df, langs, protos)
    assert got.count() == df.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[5]["lang_pred"] == "en"
    assert langid.predict(df, *langid.learn(df.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_bundles_are_linear_and_counts_whole():
    at, counts = langid.profile("The cat, the CAT")
    assert counts.sum() == len("the cat the cat") and np.allclose(langid.bundle(at, counts), sum(langid.bundle(np.array([a]), np.array([c])) for a, c in zip(at, counts)))


@needs_data
def test_quality_trees_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.rules(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).filter("n_words >= 10").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.95


@needs_data
def test_ordinal_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = ordinal.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    kept = ordinal.select_quality(docs, model)
    assert kept.columns == docs.columns
    got = docs.join(labels, "doc_id").filter(held_out(F.col("doc_id"))).join(kept.select("doc_id", F.lit(1).alias("k")).distinct(), "doc_id", "left").toPandas()
    assert ((got["k"] == 1) == (got["quality"] == 1)).mean() > 0.95


def test_ordinal_of_awkward_rows(spark):
    df = documents(spark)
    got = ordinal.select_quality(df, None)
    assert got.columns == df.columns and got.count() == df.filter("text is not null and text <> ''").count()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal.fit(df, labels) is None


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 4)).astype(np.float32)
    score = x @ np.array([2.0, -1.0, 0, 0]) + rng.logistic(size=900)
    model = ordinal.fit_ordinal(x, np.digitize(score, [-1.0, 1.5]))
    assert model.weights[0] > 1 > 0 > model.weights[1] and model.thresholds[0] < 0 < model.thresholds[1]
    tails = model.tails(x)
    assert (tails[:, 0] >= tails[:, 1]).all()


@needs_data
def test_toxicity_held_out(spark):
    docs, labels = table(spark, DATA.replace("0.01", "0.1"), "documents"), table(spark, DATA.replace("0.01", "0.1"), "labels")
    machine = toxicity.fit(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), machine).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).toPandas()
    called = got["score"] >= toxicity.PREDICT_AT
    assert called[got["toxic"] == 1].mean() > 0.75 and called[got["toxic"] == 0].mean() < 0.02


def test_toxicity_of_awkward_rows(spark):
    df = documents(spark)
    assert toxicity.score(df, None).filter("score = 0").count() == df.count()
    assert toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_word_streams_see_through_gaps():
    import pyarrow as pa

    from strandlake.llm.words import runs

    rows = ["An Idiot! x", None, "i d i o t here", "id.i0t", "", "a b", " ", "tail"]
    for run in runs([pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])]):
        s = toxicity.stream(run)
        letters = (s.x + 96).tobytes().decode("latin-1")
        assert [(r, letters[b + 1 : b + 1 + n]) for r, b, n in zip(s.row.tolist(), s.begins.tolist(), s.sizes.tolist())] == [
            (0, "an"), (0, "idiot"), (0, "x"), (2, "idiot"), (2, "here"), (3, "idiot"), (5, "ab"), (7, "tail"),
        ]
        weights = np.random.default_rng(0).normal(size=toxicity.TABLE).astype(np.float32)
        for b, n, got in zip(s.begins, s.sizes, toxicity.decisions(s, weights)):
            u = [0, *(ord(c) - 96 for c in letters[b + 1 : b + 1 + n]), 0]
            spans = [(i, j, k) for i in range(len(u)) for k in range(i + 2, min(len(u), i + toxicity.SPAN + 1)) for j in range(i + 1, k)]
            total = sum(toxicity.DECAY ** (k - i) * weights[(u[i] * 32 + u[j]) * 32 + u[k]] for i, j, k in spans)
            size = sum(toxicity.DECAY ** (2 * (k - i)) for i, _, k in spans) ** 0.5
            assert abs(total / max(size, 1e-6) - got) < 1e-3


@needs_data
def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline
    from strandlake.llm.common import stored

    docs = table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == n


def test_few_sums_reach_the_driver_however_words_are_dealt(spark, monkeypatch):
    """A session may read each file of the words by itself, as many as a repartition made."""
    words = [("bad" + c, 5, 0) for c in "abcdefgh"] + [("good" + c, 0, 5) for c in "abcdefgh"] + [("x" * 300, 1, 1)]
    df = spark.createDataFrame(words, "word string, toxic long, clean long")
    sums, put = [], toxicity.mapped
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: repartition(self, 40, *c))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    monkeypatch.setattr(toxicity, "mapped", lambda *a: sums.append(put(*a)) or sums[-1])
    try:
        for k in held:
            spark.conf.set(k, "1")
        weights, bias = toxicity.train_words(df, 8)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert all(s.rdd.getNumPartitions() <= toxicity.PARTS for s in sums)
    f = toxicity.decisions(toxicity._stream_of([w for w, _, _ in words[:16]]), weights) + bias
    assert (f[:8] > 0).all() and (f[8:] < 0).all()


def test_kernels_are_those_of_whole_tables():
    marks = toxicity.Landmarks.from_words(["idiot", "lake", "aaaaaa", "fool"])
    words = ["idiot", "a", "lak", "x" * 200, "foolidiot", "aaaa"]
    rows, table = marks.table()
    want = [toxicity.decisions(toxicity._stream_of([w]), table, rows)[0] for w in words]
    assert np.allclose(toxicity.Kernels(marks)(words), want, atol=1e-5)
