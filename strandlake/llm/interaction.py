"""Operator 13: what each of five filters removes, by itself and after the others, in every order.

A document's failures are five bits, so all that the 120 orders and five steps
say of a part (a source) follows from its 32 counts by bits: a subset-zeta
transform over them gives the documents that survive each subset of the filters,
a step of an order is the difference between two subsets that differ by its
filter, and so are the labelled documents that it costs.

Filters (a document fails A with under 50 words; B if 100 distinct words are
under 65 words; C if 100 capital letters are over 5 code points; D with one of
``#$%&*|``; E if a document of a smaller id has the same text).

Scale: texts are read once; from then on a document is a digest and a few
numbers. The smallest id of each text is summed before the shuffle and joined on
text and id, so a text that a third of all documents share is no heavy key. All
that follows has 32 rows a part.

Defined results: null text is empty, null source is ''; a document without an id
isn't a copy of anything, nor is anything of it; rows of one id and text don't
fail E by each other; of several labels of an id a 1 counts; labels without a
document are ignored; every row counts; texts of any length are read whole; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import mapped, stored, table
from strandlake.llm.words import NON_SPACE, Run, per_row, runs, span_hash, split

FILTERS = "ABCDE"
WHOLE = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")
MEASURES = ("n", "good", "toxic")
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True


def _sums(flags: np.ndarray, run: Run) -> np.ndarray:
    """How many bytes of each row are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[run.offsets[1:]] - sums[run.offsets[:-1]]


def text_failures(run: Run) -> np.ndarray:
    """The bits A to D of each text."""
    words = split(run, NON_SPACE)
    hashes = span_hash(run.data, words.starts, words.ends)
    # equal words of a row stand together in order of hash, then row
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(words.row[order].astype(np.uint16), kind="stable")]
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (words.row[order[1:]] != words.row[order[:-1]])
    n, distinct = words.counts, per_row(first, words)
    points = _sums((run.data & 0xC0) != 0x80, run)
    failures = [n < 50, 100 * distinct < 65 * n, 100 * _sums(_CAPITAL[run.data], run) > 5 * points, _sums(_MARKS[run.data], run) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failures))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        digests = pa.array([hashlib.sha256(run.raw(i)).digest() for i in range(len(run))], pa.binary())
        yield pa.RecordBatch.from_arrays([run.batch.column(0), run.batch.column(1), digests, pa.array(text_failures(run), pa.int32())], ["doc_id", "part", "digest", "failed"])


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of every document: the bits of the filters that it fails, A the lowest."""
    read = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    measured = stored(mapped(read, _measured, "doc_id long, part string, digest binary, failed int"), "interaction-masks")
    least = measured.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("least", F.lit(True))
    copy = F.when(F.col("least").isNull() & F.col("doc_id").isNotNull(), COPY).otherwise(0)
    return measured.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def mask_counts(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and bits, and how many of them are labelled so."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES[1:]]
    return failures.join(marked, "doc_id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), *sums)


def survivors(counts: Column) -> Column:
    """From an array of 32 counts by bits, that of what survives each subset of filters.

    What survives a subset fails only filters outside it, so it is the sum over
    all subsets of the complement: a bit at a time, each set takes in what the set
    without the bit holds.
    """
    bits = F.array(*(F.lit(1 << i) for i in range(len(FILTERS))))
    inner = lambda held, bit: F.transform(held, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(held, i - bit)).otherwise(F.lit(0)))
    return F.reverse(F.aggregate(bits, counts, inner))


def by_order(counts: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("failed", F.struct(*MEASURES)))).alias("by"))  # at most 32 entries
    none = F.struct(*(F.lit(0).cast("long").alias(m) for m in MEASURES))
    filled = held.select("part", F.transform(F.sequence(F.lit(0), F.lit(WHOLE)), lambda m: F.coalesce(F.element_at("by", m), none)).alias("cells"))
    left = filled.select("part", *(survivors(F.col(f"cells.{m}")).alias(m) for m in MEASURES))
    # a filter comes after a given set of others in so many orders
    weight = F.array(*(F.lit(w).cast("long") for w in (24, 6, 4, 6, 24)))
    gain = lambda bit: F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(WHOLE)), lambda s: s.bitwiseAND(F.lit(bit)) == 0), F.lit(0).cast("long"), lambda a, s: a + F.get(weight, F.bit_count(s)) * (F.get("n", s) - F.get("n", s + bit)))
    fair = left.withColumn("fair", F.array(*(gain(1 << i) for i in range(len(FILTERS)))))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = fair.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A"))
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.substring("filter_order", i, F.lit(1)))
    before = F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda a, c: a + bit(c))
    at = steps.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    after = F.col("before") + F.col("own")
    lost = lambda m: F.get(m, F.col("before")) - F.get(m, after)
    fails = F.get("n", F.lit(0)) - F.get("n", F.col("own"))
    only = F.get("n", WHOLE - F.col("own")) - F.get("n", F.lit(WHOLE))
    fair_place = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord("A")
    return at.select("part", "filter_order", "step", F.get("n", after).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"), only.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("fair", fair_place).alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return by_order(mask_counts(masks(documents), labels))


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS f, chr((64 + a.i)::INT) || chr((64 + b.i)::INT) || chr((64 + c.i)::INT) || chr((64 + d.i)::INT) || chr((64 + e.i)::INT) AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT c.*, o.filter_order, x.i AS step, o.f[x.i] AS own, fails[o.f[x.i]] AS failing, coalesce(list_bool_or(list_transform(o.f[1:x.i - 1], lambda k: c.fails[k])), false) AS gone, len(list_filter(c.fails, lambda k: k)) = 1 AS alone FROM c, o, x),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
