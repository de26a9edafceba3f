"""Operator 12: how far the sources of a language part in their words.

The terms of every text are counted by language
and source, over runs of a few megabytes of text first (numpy) and then by an aggregation; all else is plain relational: each language keeps the terms that stand in enough of its documents,
the occurring groups are crossed with their language's kept terms so that zeros
count too, and a self-join on language and term sums the squared differences of
smoothed shares of two sources. Shares are whole numbers out of a thousand
million and all divisions are of whole numbers, so results don't depend on order.

Scale: counts are summed in each task before they are shuffled, by language,
source and term, so a popular term or source is no more than a row a task. The
cross with the kept terms is an equi-join on the language and a slice of its
terms, and the self-join meets a row of each source at each term; the smaller
source leads, so each pair is summed once.

Defined results: null text, lang and source count as ''; a row is a document,
repeated rows and those without an id too; texts of any length are exploded
whole; a language of one source has no pairs, one without kept terms has pairs
of value 0; ties rank by the item's bytes; an empty table gives an empty result;
further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import dropped, mapped, stored, table
from strandlake.llm.words import LOWER, U64, laid, mix, runs, span_hash, split

#: Documents of a language that a kept term must stand in.
LEAST_DOCUMENTS = 10
#: Ranks of the terms that are reported for a group.
TOP_TERMS = 10
#: Whole of the shares.
UNIT = 1_000_000_000
#: Parts of a language's terms, for crossing them with its sources.
SLICES = 64
#: Bytes of text whose terms are counted together before they go to Spark.
RUN_BYTES = 4 << 20
#: Bytes of terms, [^\x00-\x40\x5B-\x60\x7B-\x7F], once A to Z are lower-cased.
_TERM = np.zeros(256, bool)
_TERM[0x61:0x7B] = True
_TERM[0x80:] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of each run of rows (lang, source, text): occurrences, and rows that hold the term."""
    for run in runs(batches, limit=RUN_BYTES, rows=1 << 16):
        data = LOWER[run.data]
        words = split(run, _TERM, data)
        pair = pa.StructArray.from_arrays([run.batch.column(0), run.batch.column(1)], ["lang", "source"])
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in pair.to_pylist()], np.int64)
        of = group[words.row]
        # equal terms of a group beside each other, and there by row
        key = mix(span_hash(data, words.starts, words.ends) ^ mix(of.astype(U64)))
        order = np.argsort(key, kind="stable")
        key, row = key[order], words.row[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= row[1:] != row[:-1]
        n = np.diff(np.append(first, len(key)))
        df = np.add.reduceat(other.astype(np.int64), first) if len(first) else n
        at = order[first]
        text, offsets = laid(data, words.starts[at], words.ends[at])
        term = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.string())
        of = pa.array(of[at])
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(of) for i in range(2))
        yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])


def occurrences(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and the documents that hold the term. Terms are counted by run of
    rows first, in which they are told apart by 64-bit hashes."""
    counts = mapped(documents.select("lang", "source", "text"), _counted, "lang string, source string, term string, n long, df long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact at any size."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", above, (total + 2 * terms).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): both are at most UNIT + 1, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def dense(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The occurring groups (lang, source), and a stored row (lang, source, term, n, p, q) for each group and kept term of its language."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    read = documents.select(blank("lang"), blank("source"), "text")
    groups = stored(read.select("lang", "source").distinct(), "divergence-groups")
    counts = stored(occurrences(read), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).filter(F.col("df") >= least).drop("df")
    kept = stored(kept, "divergence-kept")
    size = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int"))
    spread = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    held = sliced.join(spread, ["lang", "slice"]).drop("slice").join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    held = stored(held.select("lang", "source", "term", "lang_n", F.coalesce("n", F.lit(0)).alias("n")), "divergence-dense")
    total = held.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(size, "lang")
    own, whole = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    out = stored(held.join(total, ["lang", "source"]).select("lang", "source", "term", "n", own.alias("p"), whole.alias("q")), "divergence-shares")
    dropped(counts, kept, held)
    return groups, out


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of different sources of a language."""
    a = shares.select("lang", "term", "source", "p")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    sums = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(gap(F.col("p"), F.col("other"))).alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    met = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    return met.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def terms(shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    return shares.filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance, and the terms that mark a source most."""
    groups, shares = dense(documents, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs(groups, shares), "pair").unionByName(ranked(terms(shares), "term").filter(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(ln)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000 * (x.n + 2)::HUGEINT) // (s.total + 2 * v.v) AS p, 1 + (1000000000 * (x.ln + 2)::HUGEINT) // (v.total + 2 * v.v) AS q FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN v ON v.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
