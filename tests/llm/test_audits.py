"""Operators 12 and 13 against plain loops, as registered over awkward tables, and over empty ones."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence, interaction, queries
from tests.llm.corpus import documents, lower, spaced


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Several languages and sources, null and empty ones, copies, extra clashing columns; and the same, empty."""
    root = tmp_path_factory.mktemp("audits")
    docs = documents(spark, ["ABC DEF # GHI", "shared words here " * 40, "Shared $ words", "one long " * 30_000])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 1, "fr").otherwise("en"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 4, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    docs = docs.select("*", F.lit(1).alias("term"), F.lit(2).alias("n"), F.lit("p").alias("part"), F.lit(3).alias("failed"))
    docs = docs.unionByName(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(900).cast("long")))
    labels = docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")).limit(4)).unionByName(spark.createDataFrame([(None, 1, 1), (7777, 1, 1), (3, None, None)], labels.schema))
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{root}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return root


def rows(spark, tables):
    return spark.read.parquet(f"{tables}/full/documents.parquet").collect()


def audited(docs, least, top):
    """Operator 12 by loops."""
    terms = [(r["lang"] or "", r["source"] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(r["text"]))) for r in docs]
    out = []
    for lang in {x[0] for x in terms}:
        df, counts = Counter(), {}
        for _, source, words in (x for x in terms if x[0] == lang):
            df.update(set(words))
            counts.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts:
            found = [("pair", o, sum(gap(shares[s][t], shares[o][t]) for t in kept)) for o in counts if o != s]
            found += [("term", t, gap(shares[s][t], whole[t])) for t in kept if counts[s][t] and shares[s][t] > whole[t]]
            for part in ("pair", "term"):
                ordered = sorted((-v, i.encode(), i) for p, i, v in found if p == part)
                out += [(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (2, 3), (1000, 10)])
def test_divergence_is_that_of_loops(spark, tables, least, top):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    got = sorted(tuple(r) for r in divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(docs.collect(), least, top)


def test_shares_are_exact_where_longs_are_short(spark):
    n = 9_000_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(n + 5), F.lit(7)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (n + 5 + 14)


def failures(docs):
    least = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    for r in docs:
        t, w = r["text"] or "", spaced(r["text"])
        copy = r["doc_id"] is not None and r["doc_id"] > least[t]
        yield r, (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), copy)


def test_interaction_is_that_of_loops(spark, tables):
    labels = spark.read.parquet(f"{tables}/full/labels.parquet").collect()
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1} for c in ("quality", "toxic"))
    parts = {}
    for r, failed in failures(rows(spark, tables)):
        parts.setdefault(r["source"] or "", []).append((r["doc_id"], failed))
    want, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone, stay = [d for d in left if d[1][k]], [d for d in left if not d[1][k]]
                fails = [d for d in docs if d[1][k]]
                shapley[part, f] += len(gone)
                want[part, order, step] = (len(stay), len(gone), len(fails) - len(gone), sum(sum(d[1]) == 1 for d in fails), sum(d[0] in good for d in gone if d[0] is not None), sum(d[0] in toxic for d in gone if d[0] is not None))
                left = stay
    got = queries.queries()["op13_interaction"](spark, f"{tables}/full").collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[3:9] == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_text_failures_of_a_mixed_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    got = Counter((r["doc_id"], r["failed"]) for r in interaction.masks(docs).collect())
    assert got == Counter((r["doc_id"], sum(x << i for i, x in enumerate(failed))) for r, failed in failures(docs.collect()))


@pytest.mark.parametrize("name", ["op12_divergence", "op13_interaction"])
def test_empty_tables(spark, tables, name):
    full, empty = (queries.queries()[name](spark, f"{tables}/{kind}") for kind in ("full", "empty"))
    assert full.count() > 0 and empty.count() == 0 and full.dtypes == empty.dtypes


def test_terms_go_to_spark_once_for_each_run(spark, tables, monkeypatch):
    docs = spark.createDataFrame([(i, "The wind of the lake " * 50, "en" if i % 2 else None, "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    sent, put = [], divergence.mapped
    monkeypatch.setattr(divergence, "mapped", lambda *a: sent.append(put(*a)) or sent[-1])
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["df"]) for r in divergence.occurrences(docs.coalesce(1)).collect()}
    assert sent[0].count() == 8
    assert got == {(lang, "s", t): (5000 * k, 100) for lang in ("en", None) for t, k in (("the", 2), ("wind", 1), ("of", 1), ("lake", 1))}
    full = spark.read.parquet(f"{tables}/full/documents.parquet")
    monkeypatch.setattr(divergence, "RUN_BYTES", 40)
    got = sorted(tuple(r) for r in divergence.audit(full, 2, 3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(full.collect(), 2, 3)
