"""Operator 11: scoring of texts by a causal self-attention model of subword ids.

A text is lower-cased (A to Z), cut at white space, and its words go as subword
ids of a public tokenizer, a blank before each, to the model of ``attention``:
each id is scored once, with the ids of its window before it, and then the end.
Beside it stands the base score, of single words and the end with smoothed counts.

What is learnt comes from all training documents. Words are counted over them
all, in each task first. Subword ids are counted from the words' counts. The model
trains on all windows of all training documents, as they are scored; they are dealt to
shards of about ``SHARD`` windows, each a task's work. The first shard warms the
model up (``WARM`` rounds), then the shards train side by side, an equal share of them in each of
``ROUNDS`` rounds, after which their parameters are averaged: exact decimals, so that the order of shards doesn't matter.

Scale: words of over a millionth of all training tokens are known to each task
(2^20 of them at most, two numbers each). All other words of a document are
joined with the counts as rows, one for each distinct word of a document, and none
of them is a heavy key, since it is rare. Parameters (some 100,000 numbers) and
id counts are all that the driver holds. No lineage is kept: counts, windows and
scores are tables in the shared folder. Texts are encoded once: what trains is scored from the same stored lines.

Defined results: null text is empty and scored as an end alone; a row without an
id isn't held out, and teaches; repeated rows are scored, and teach, as often as
they stand; texts of any length are scored whole; without training documents all
counts are 0 and ids are equally likely; an empty table gives an empty result;
further columns aren't read. Words are told apart by their bytes in the counts, and by
64-bit hashes among the frequent ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import attention
from strandlake.llm.attention import BLOCK, Model, Vocabulary
from strandlake.llm.common import dropped, mapped, small_batches, stored, table
from strandlake.llm.tokens import PieceEncoder, tokenizer_path
from strandlake.llm.words import LOWER, NON_SPACE, U64, Run, Words, laid, mix, per_row, runs, span_hash, split

IDS = 50_257
END = 50_256
#: Blocks of ids that are stored as one row for training.
STRETCH = 32
#: Windows of a shard, about; steps to which small shards are gone through twice, windows of a step; rounds of the first shard alone, and those that all shards are dealt to.
SHARD, STEPS, BATCH, WARM, ROUNDS = 262_144, 256, 1024, 2, 2
RATE = 0.02
#: A word is frequent with over one in so many of the training tokens, so that at most this many are.
FREQUENT = 1 << 20
_HALF = float(np.log10(0.5))
_TEN = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    """True for the rows that nothing is learnt from: crc32 of the id as text leaves 1 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


# -- words of a run ----------------------------------------------------------


class Distinct:
    """The distinct words of a run: where one of each stands, and which one each word is."""

    def __init__(self, run: Run) -> None:
        self.data = LOWER[run.data]
        self.words: Words = split(run, NON_SPACE, self.data)
        hashes = span_hash(self.data, self.words.starts, self.words.ends)
        self.hashes, self.first, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = self.words.starts[self.first], self.words.ends[self.first]

    def text(self, some: np.ndarray) -> pa.Array:
        """The distinct words of these numbers."""
        data, offsets = laid(self.data, self.starts[some], self.ends[some])
        return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def encoded(self, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words, one after the other, and how many each has."""
        return encode(encoder, self.data, self.starts, self.ends)


@lru_cache(1)
def _encoder(path: str) -> PieceEncoder:
    """Stays with the worker, for all passes: 2^18 pieces at most, some 20 MB beside the tokenizer itself."""
    return PieceEncoder(path)


def encode(encoder: PieceEncoder, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words data[start:end], a blank before each, and how many each has."""
    lined, offsets = laid(data, starts, ends, 1)
    return encoder.encode(Run(None, lined, offsets))


def joined(ids: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, given those of the distinct ones and which one each word is, and how many each word has."""
    begins = np.cumsum(sizes) - sizes
    size = sizes[of]
    offset = np.cumsum(size) - size
    return ids[np.repeat(begins[of] - offset, size) + np.arange(int(size.sum()))], size


# -- counts ------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each run, and the ends as a null word."""
    for run in runs(batches, limit=4 << 20, rows=1 << 16):
        held = Distinct(run)
        n = np.bincount(held.of, minlength=len(held.first))
        yield pa.RecordBatch.from_arrays([held.text(np.arange(len(n))).cast(pa.string()), pa.array(n)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([len(run)])], ["word", "n"])


def word_counts(documents: DataFrame) -> DataFrame:
    """A stored (word, n) of all texts; the null word is the end."""
    counts = mapped(documents.select("text"), _counted, "word string, n long")
    return stored(counts.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def _id_counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    total, own = np.zeros(IDS, np.int64), _encoder(path)
    for run in runs(batches, "word"):
        n = run.batch.column(1).to_numpy()
        there = np.flatnonzero(~run.batch.column(0).is_null().to_numpy(zero_copy_only=False))
        total[END] += n.sum() - n[there].sum()
        ids, sizes = encode(own, run.data, run.offsets[:-1][there], run.offsets[1:][there])
        total += np.bincount(ids, np.repeat(n[there], sizes), IDS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each subword id stands in all texts, the end included."""
    found = mapped(counts.select("word", "n"), partial(_id_counted, path=path), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(IDS, np.int64)
    out[found["id"].to_numpy(int)] = found["n"].to_numpy(np.int64)
    return out


# -- texts as ranks ----------------------------------------------------------

_KINDS = {"number": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "outside": pa.float64(), "rare": pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])), "learnt": pa.bool_(), "key": pa.int64(), "blocks": pa.int32(), "line": pa.binary()}
_ROWS = "number long, doc_id long, n_tokens long, n_known long, base double, outside double, rare array<struct<word:string,n:long>>, learnt boolean, key long, blocks int, line binary"


@dataclass
class Known:
    """The frequent words by their hashes, in order, the logarithms of their counts, and how many ends there are."""

    hashes: np.ndarray
    logs: np.ndarray
    ends: int


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(rows, kind)) for k, kind in _KINDS.items()], schema=pa.schema(list(_KINDS.items())))


def _laid(batches: Iterator[pa.RecordBatch], path: str, v: Vocabulary, known: Known) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: each text, with each distinct word of it that isn't frequent, and its ranks, a line for each stretch.

    Words that aren't frequent are unknown until the counts are joined, and stand in a column of their own, so that
    whoever reads the lines passes them over; ``outside`` is what ids outside the head add to
    the score. A line is the block before the stretch, the rank before its first, and the stretch's blocks, missing
    ranks filled up; its key is even.
    """
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    own, end = _encoder(path), v.rank[END]
    frequent, logs = known.hashes, known.logs
    # what stands before a row: nothing, and then the end of another
    lead = np.full(BLOCK + 1, v.pad, np.int16)
    lead[-1] = end
    for run in runs(batches):
        m = len(run)
        held = Distinct(run)
        words = held.words
        place = np.minimum(np.searchsorted(frequent, held.hashes), max(len(frequent) - 1, 0))
        met = frequent[place] == held.hashes if len(frequent) else np.zeros(len(held.hashes), bool)
        log = np.where(met, logs[place] if len(frequent) else _HALF, _HALF)
        base = np.bincount(words.row, log[held.of], m) + np.log10(known.ends + 0.5)
        n_known = per_row(met[held.of], words) + (known.ends > 0)
        ids, sizes = held.encoded(own)
        ids, sizes = joined(ids, sizes.astype(np.int64), held.of)
        counts = per_row(sizes, words)
        outside = np.bincount(np.repeat(np.arange(m), counts), v.log_share[ids], m)
        numbers = number + np.arange(m)
        number += m
        doc_id, learnt = run.batch.column(0), run.batch.column(2).to_numpy(zero_copy_only=False)
        rare = np.flatnonzero(~met[held.of])
        pair, n = np.unique(words.row[rare] * np.int64(len(held.first)) + held.of[rare], return_counts=True)
        per_text = np.searchsorted(pair, np.arange(m + 1) * np.int64(len(held.first))).astype(np.int32)
        named = pa.StructArray.from_arrays([held.text(pair % max(len(held.first), 1)).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
        listed = pa.ListArray.from_arrays(pa.array(per_text), named)
        yield _batch(m, number=pa.array(numbers), doc_id=doc_id, n_tokens=pa.array(words.counts + 1), n_known=pa.array(n_known), base=pa.array(base), outside=pa.array(outside), rare=listed)
        _, following, starts = attention.blocks(v.rank[ids].astype(np.int16), counts, end, v.pad)
        of_row = mix(mix(np.nan_to_num(doc_id.to_numpy(zero_copy_only=False)).astype(np.int64).astype(U64)) ^ run.row_hash())
        many = np.diff(np.append(starts, len(following)))
        lines, sizes, rows, places = [], [], [], []
        for row in range(m):
            line = np.concatenate([lead, following[starts[row] : starts[row] + many[row]].ravel()])
            for place, at in enumerate(range(0, int(many[row]), STRETCH)):
                n = min(STRETCH, int(many[row]) - at)
                lines.append(line[at * BLOCK : (at + n + 1) * BLOCK + 1].tobytes())
                sizes.append(n)
                rows.append(row)
                places.append(place)
        keys = mix(of_row[rows] + np.array(places, U64)).view(np.int64)
        yield _batch(len(lines), number=pa.array(numbers[rows]), learnt=pa.array(learnt[rows]), key=pa.array(keys), blocks=pa.array(sizes, pa.int32()), line=pa.array(lines, pa.binary()))


def laid_out(documents: DataFrame, v: Vocabulary, path: str, known: Known) -> DataFrame:
    """A stored table of the rows (doc_id, text, learnt) as texts with their rare words, and lines."""
    return stored(mapped(documents.select("doc_id", "text", "learnt"), partial(_laid, path=path, v=v, known=known), _ROWS), "lm-texts")


# -- training ----------------------------------------------------------------


def training_lines(documents: DataFrame, v: Vocabulary, path: str) -> DataFrame:
    """The (key, blocks, line) of all stretches of every document."""
    nothing = Known(np.zeros(0, U64), np.zeros(0), 0)
    return laid_out(documents.withColumn("learnt", F.lit(True)), v, path, nothing).filter("line is not null").select("key", "blocks", "line")


def unpacked(blocks: np.ndarray, lines: list[bytes]) -> np.ndarray:
    """The windows (n, 3, BLOCK) of lines: the block before each block, the block, and what follows its places."""
    ranks = np.frombuffer(b"".join(lines), np.int16)
    size = (blocks + 1) * BLOCK + 1
    first = np.repeat(np.cumsum(size) - size, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    whole = np.lib.stride_tricks.sliding_window_view(ranks, 2 * BLOCK + 1)[first] if len(first) else np.zeros((0, 2 * BLOCK + 1), np.int16)
    return np.stack([whole[:, at : at + BLOCK] for at in (0, BLOCK, BLOCK + 1)], 1)


def _trainer(flat: np.ndarray, v: Vocabulary) -> Callable[[pa.Table], pa.Table]:
    """What trains on all windows of one shard, in an order that follows from its keys."""

    def trained(shard: pa.Table) -> pa.Table:
        held = shard.sort_by([("key", "ascending"), ("line", "ascending")])
        windows = unpacked(held.column("blocks").to_numpy().astype(np.int64), held.column("line").to_pylist())
        windows = windows[np.random.default_rng(len(windows)).permutation(len(windows))]
        whole = -(-len(windows) // BATCH)
        steps = max(whole, min(STEPS, 2 * whole))  # few windows aren't learnt by heart
        found = attention.train(flat, v, windows, steps, BATCH, RATE)
        return pa.table({"n": pa.array([len(windows)]), "flat": pa.array([found.astype(float)], pa.list_(pa.float64()))})

    return trained


def fitted(lines: DataFrame, v: Vocabulary) -> np.ndarray:
    """Parameters after the warm-up and the rounds, in which each shard has its turn; those that tell nothing but shares where there is no line."""
    flat = attention.started(v)
    shards = max(1, round((lines.agg(F.sum("blocks")).first()[0] or 0) / SHARD))
    small_batches(lines.sparkSession)
    dealt = lines.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    rounds = min(ROUNDS, shards)
    for turn in range(WARM + rounds):
        some = dealt.filter(F.col("shard") % rounds == turn - WARM) if turn >= WARM else dealt.filter("shard = 0")
        trained = some.groupBy("shard").applyInArrow(_trainer(flat, v), "n long, flat array<double>")
        each = trained.select("n", F.posexplode("flat").alias("at", "x"))
        exact = F.sum((F.col("x").cast("decimal(20,10)") * F.col("n").cast("decimal(10,0)")))
        mean = each.groupBy("at").agg((exact.cast("double") / F.sum("n")).alias("x")).toPandas()  # as many rows as parameters
        if len(mean):
            flat = mean.sort_values("at")["x"].to_numpy(np.float32)
    return flat


# -- scoring -----------------------------------------------------------------


def _scored(batches: Iterator[pa.RecordBatch], v: Vocabulary, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(number, chance): the logarithm of each line's chance."""
    model = Model(flat, v)
    for batch in batches:
        if batch.num_rows:
            ranks = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int16)
            chance = attention.score_lines(model, batch.column(1).to_numpy().astype(np.int64), ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance)], ["number", "chance"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "word"):
        yield pa.RecordBatch.from_arrays([pa.array(run.row_hash().view(np.int64)), run.batch.column(1)], ["hash", "n"])


def scores(documents: DataFrame, learnt: Column, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``learnt`` holds teach."""
    path = path or tokenizer_path()
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~learnt).alias("held_out"))
    training = read.filter(~F.col("held_out"))
    counts = word_counts(training)
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    ids = id_counts(counts, path)
    v = attention.vocabulary(ids, END)
    frequent: pd.DataFrame = mapped(counts.filter(F.col("word").isNotNull() & (F.col("n") > total // FREQUENT)), _hashed, "hash long, n long").toPandas()
    hashes = frequent["hash"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    known = Known(hashes[order], np.log10(frequent["n"].to_numpy(float) + 0.5)[order], ends)
    held = laid_out(read.withColumn("learnt", ~F.col("held_out")), v, path, known)
    lines = held.filter("line is not null")
    flat = fitted(lines.filter("learnt").select("key", "blocks", "line"), v)
    small_batches(documents.sparkSession)
    chances = stored(mapped(lines.select("number", "blocks", "line"), partial(_scored, v=v, flat=flat), "number long, chance double"), "lm-chances")
    rare = held.filter("line is null").select("number", F.explode("rare").alias("rare")).select("number", "rare.word", F.col("rare.n").alias("times")).join(counts.filter("word is not null"), "word")
    gains = rare.select("number", F.col("times").alias("more"), (F.col("times") * (F.log10(F.col("n") + 0.5) - _HALF)).alias("gain"), F.lit(0.0).alias("chance"))
    found = gains.unionByName(chances.select("number", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), "chance"))
    found = found.groupBy("number").agg(*(F.sum(c).alias(c) for c in ("more", "gain", "chance")))
    rows = held.filter("line is null").select("number", "doc_id", "n_tokens", "n_known", "base", "outside").join(found, "number", "left")
    less = F.log10(F.lit(float(total + 0.5 * (distinct + 1))))
    out = rows.select(
        "doc_id",
        (~learnt).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * less).alias("base_score"),
        ((F.col("chance") + F.col("outside")) / _TEN).alias("score"),
    )
    out = stored(out, "lm-scores")
    dropped(counts, held, chances)
    return out


def op11_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id")))
