"""Operator 7: benchmark decontamination by winnowing.

Every run of ``SPAN`` words that a document shares with a benchmark item holds a
k-gram which is the least of its sliding window in the document, so the least
k-grams of the documents joined with all k-grams of the items find each shared
span. A document's fingerprint carries the hashes of the words around it, the
item's k-gram those around it there; a hit is extended by comparing both. Items
of fewer than ``SPAN`` words are one window each and meet the documents' grams
of just that length.

Defined results: null and empty texts have no words and no hit; a text of any
length is read whole; repeated rows come back as often as they stand, those of a
null doc_id too; further columns are left out, or pass through ``clean``; items without a word match nothing; repeated
items count once for each item_id, all of a null id as one, which stands last in
items and has no part in their hash; an empty benchmark leaves every row clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.llm.common import mapped, stored, table, text_hash
from strandlake.llm.words import ALNUM, LOWER, U64, Run, Words, grams, runs, same_row, span_hash, split

SPAN = 10
GRAM = 5
#: Items' k-grams up to this many (some 130 bytes each) are sent to every task; beyond it both sides are shuffled.
BROADCAST_GRAMS = 250_000

_FIELDS = "doc_id long, row_hash long, pos int, h long, near binary"


def _words(run: Run) -> tuple[Words, np.ndarray]:
    data = LOWER[run.data]
    words = split(run, ALNUM, data)
    return words, span_hash(data, words.starts, words.ends)


def _around(hashes: np.ndarray, words: Words, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """(len(at), before + after) 32-bit hashes of the words around each position; 0 outside the row."""
    near = at[:, None] + np.arange(-before, after)
    held = np.clip(near, 0, max(0, len(hashes) - 1))
    short = (hashes >> U64(32)).astype(np.uint32) | np.uint32(1)
    out = short[held]
    out[(near != held) | (words.row[held] != words.row[at][:, None])] = 0
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _least(values: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the (rightmost) minimum of some window of consecutive k-grams of one row."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    key = np.where(ok, values, U64(0xFFFFFFFFFFFFFFFF))
    m = max(0, n - window + 1)
    best, where = key[:m].copy(), np.arange(m)
    for j in range(1, window):
        less = key[j : j + m] <= best
        best = np.where(less, key[j : j + m], best)
        where = np.where(less, np.arange(j, j + m), where)
    # a window counts only where all its k-grams stand in one row
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(~ok, out=bad[1:])
    whole = bad[window:][:m] == bad[:m]
    return np.unique(where[whole])


def _document_grams(batches: Iterator[pa.RecordBatch], short: list[int], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint, and one with pos -1 and h the word count for each document."""
    window, before, after = span - k + 1, span - k, span
    for run in runs(batches):
        words, hashes = _words(run)
        ids = np.asarray(run.batch.column(0).to_numpy(zero_copy_only=False))
        nulls = run.batch.column(0).is_null()
        row_hash = np.asarray(run.batch.column(1).to_numpy(zero_copy_only=False))
        index = words.index
        parts = [(np.arange(len(run)), np.full(len(run), -1), words.counts.astype(np.int64), _binary(np.zeros((len(run), 0), np.uint32)))]
        # the boundary of a row breaks a window: mark the k-grams that cross it
        at = _least(grams(hashes, k), same_row(words, k), window)
        if len(at):
            parts.append((words.row[at], index[at], grams(hashes, k)[at].view(np.int64), _binary(_around(hashes, words, at, before, after))))
        for m in short:
            at = np.flatnonzero(same_row(words, m))
            if len(at):
                parts.append((words.row[at], index[at], grams(hashes, m, salt=m)[at].view(np.int64), _binary(_around(hashes, words, at, 0, m))))
        for row, pos, h, near in parts:
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [run.batch.column(0).take(where) if nulls.true_count else pa.array(ids[row], pa.int64()), pa.array(row_hash[row]), pa.array(pos.astype(np.int32)), pa.array(h), near],
                ["doc_id", "row_hash", "pos", "h", "near"],
            )


def _item_grams(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    before, after = span - k, span
    for run in runs(batches):
        words, hashes = _words(run)
        counts = words.counts
        parts = []
        long = counts >= span
        at = np.flatnonzero(same_row(words, k))
        at = at[long[words.row[at]]]
        parts.append((at, k, grams(hashes, k)[at] if len(at) else np.zeros(0, U64), _around(hashes, words, at, before, after)))
        for m in np.unique(counts[(counts > 0) & (counts < span)]).tolist():
            at = words.first[:-1][counts == m]
            parts.append((at, m, grams(hashes, m, salt=m)[at], _around(hashes, words, at, 0, m)))
        for at, m, h, near in parts:
            if len(at):
                size = counts[words.row[at]]
                yield pa.RecordBatch.from_arrays(
                    [run.batch.column(0).take(pa.array(words.row[at])), pa.array(np.minimum(size, span).astype(np.int32)), pa.array(h.view(np.int64)), _binary(near)],
                    ["item_id", "size", "h", "item_near"],
                )


def _extended(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Joined hits to the document spans [start, end) that whole windows of the item cover."""
    for batch in batches:
        size, pos = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("size", "pos"))
        near, item = (batch.column(batch.schema.get_field_index(x)) for x in ("near", "item_near"))
        keep, start, end = [], [], []
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in col.take(pa.array(rows))]) for col in (near, item))
            same = (x == y) & (x != 0)
            lead = 0 if s < span else span - k
            for i in range(same.shape[1] - s + 1):
                hit = rows[same[:, i : i + s].all(1)]
                keep.append(hit)
                start.append(pos[hit] - lead + i)
                end.append(pos[hit] - lead + i + s)
        if keep:
            keep, start, end = (np.concatenate(v) for v in (keep, start, end))
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(x)) for x in ("doc_id", "row_hash", "item_id")), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "row_hash", "item_id", "start", "end"])


def benchmark_grams(benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return mapped(items, partial(_item_grams, span=span, k=k), "item_id string, size int, h long, item_near binary").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The hit spans (doc_id, row_hash, item_id, start, end), in words, and the rows (doc_id, row_hash, n_words, copies)."""
    items = stored(benchmark_grams(benchmark, span, k), "items")
    n, lengths = items.agg(F.count("*"), F.collect_set(F.when(F.col("size") < span, F.col("size")))).first()  # 9 lengths at most
    rows = documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), "text")
    prints = mapped(rows, partial(_document_grams, short=sorted(lengths), span=span, k=k), _FIELDS)
    side = F.broadcast(items) if n <= BROADCAST_GRAMS else items
    joined = prints.join(side, "h", "left").filter("pos = -1 or size is not null")
    joined = stored(joined, "joined")
    rows = joined.filter("pos = -1").groupBy("doc_id", "row_hash").agg(F.max("h").alias("n_words"), F.count("*").alias("copies"))
    found = mapped(joined.filter("pos >= 0 and size is not null"), partial(_extended, span=span, k=k), "doc_id long, row_hash long, item_id string, start int, end int")
    return found.distinct(), rows


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """A row per document: n_words, n_hit (words inside an item's window), n_items, items and contaminated."""
    found, rows = hits(documents, benchmark, span, k)
    found = stored(found, "spans")
    key = ["doc_id", "row_hash"]
    spans = found.select(*key, "start", "end").distinct()
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).alias("n_hit"))
    items = found.groupBy(*key).agg(F.concat(F.array_sort(F.collect_set("item_id")), F.when(F.count("*") > F.count("item_id"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))).alias("items"))
    each = n_hit.join(items, [n_hit[c].eqNullSafe(items[c]) for c in key]).select(n_hit["doc_id"], n_hit["row_hash"], "n_hit", "items")
    out = rows.join(each, [rows[c].eqNullSafe(each[c]) for c in key], "left")
    return out.select(
        rows["doc_id"],
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast(T.ArrayType(T.StringType()))).alias("items"),
    ).drop("_copy")


def clean(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """The rows, with their own columns, that share no item's window."""
    # which item it is doesn't matter here, so grams that many items hold are joined once
    found, _ = hits(documents, benchmark.withColumn("item_id", F.lit(None).cast("string")), span, k)
    bad = stored(found.select("doc_id", "row_hash").distinct(), "contaminated")
    same = documents["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (text_hash(documents["text"]) == bad["row_hash"])
    return documents.join(bad, same, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
