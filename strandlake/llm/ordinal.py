"""Operator 5: quality classifier, ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 for poor quality, 1 for good quality marked toxic,
2 for good quality. A text is hashed into byte 3-gram buckets (square roots of
their shares) and two marker buckets for words that repeat; one weight vector is
shared by all grades, and ordered thresholds cut its score:
P(grade >= j) = sigmoid(w.x - t_j). Selection uses the tail P(grade >= 1) or the
expected grade, the sum of the tails.

Defined results: null and empty texts have tails 0 and are rejected; where
nothing was learnt from, all other texts have tails 1 and are kept. A text of
any length is read whole. Labels of one document that contradict each other
count by their greatest grade; a null doc_id teaches nothing and is graded like
any other. Repeated rows come back as often as they stand; an empty table gives
an empty result; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, labelled_sample, mapped, small_batches, table, tidied
from strandlake.llm.quality import statistics
from strandlake.llm.words import Run, runs, runs_of

#: Labelled documents that the weights are fitted on, at most.
FIT_ROWS = 4000
BITS = 12
MARKERS = 2
GRADES = 3
#: Rows whose buckets stand side by side in memory.
ROWS = 512


def hashed(run: Run) -> np.ndarray:
    """(rows, buckets): square roots of the shares of hashed 3-grams, and of repeating words."""
    buckets = 1 << BITS
    data = run.data.astype(np.uint32)
    n = max(0, len(data) - 2)
    code = (data[:n] * np.uint32(0x9E3779B1) + data[1 : n + 1] * np.uint32(0x85EBCA6B) + data[2 : n + 2] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    code = (code >> np.uint32(32 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(run)), np.diff(run.offsets))
    own = row[:n] == row[2 : n + 2] if n else np.zeros(0, bool)
    total = np.bincount(row[:n][own], minlength=len(run))
    counts = np.bincount(row[:n][own] * buckets + code[own], minlength=len(run) * buckets).reshape(len(run), buckets)
    out = np.zeros((len(run), buckets + MARKERS), np.float32)
    np.sqrt(counts, out=out[:, :buckets], casting="same_kind")
    out[:, :buckets] /= np.sqrt(np.maximum(total, 1))[:, None]
    s = statistics(run)
    words = np.maximum(s["n_words"], 1)
    out[:, buckets] = np.sqrt(s["n_same_next"] / words)
    out[:, buckets + 1] = np.sqrt(s["n_repeat_words"] / words)
    return out


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade >= j) for j from 1."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights.astype(x.dtype)).astype(float)[:, None] - self.thresholds[None, :], -50, 50)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES, ridge: float = 1e-4, steps: int = 300, rate: float = 0.1) -> Ordinal:
    """Full-batch Adam on the cumulative logit likelihood; the thresholds are a start and positive gaps, so they stay ordered.

    ``x`` stays in its own type: its products would copy it to a wider one else.
    """
    w = np.zeros(x.shape[1])
    share = np.clip([(grade >= j).mean() for j in range(1, grades)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    state = np.concatenate([w, raw])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        w, raw = state[: x.shape[1]], state[x.shape[1] :]
        gaps = np.exp(raw[1:])
        t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        tail = 1 / (1 + np.exp(-np.clip((x @ w.astype(x.dtype)).astype(float)[:, None] - t[None, :], -50, 50)))
        # P(grade = g) is the difference of two tails; its log's slope in the score and in each threshold
        full = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], 1)
        p = np.maximum(full[np.arange(len(x)), grade] - full[np.arange(len(x)), grade + 1], 1e-9)
        d = full * (1 - full)
        score = (d[np.arange(len(x)), grade] - d[np.arange(len(x)), grade + 1]) / p
        gw = -(score.astype(x.dtype) @ x).astype(float) / len(x) + ridge * w
        gt = np.array([((d[:, j] * ((grade == j).astype(float) - (grade == j - 1))) / p).mean() for j in range(1, grades)])
        graw = np.concatenate([[gt.sum()], [gt[j:].sum() * gaps[j - 1] for j in range(1, grades - 1)]])
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = state[x.shape[1] :]
    return Ordinal(state[: x.shape[1]], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, rows=ROWS):
        x = hashed(run)
        at = [np.flatnonzero(r) for r in x]
        yield pa.RecordBatch.from_arrays(
            [run.batch.column(0), run.batch.column(1), pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32()))],
            ["doc_id", "grade", "at", "value"],
        )


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the rows with a quality."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("quality is not null").select("doc_id", grade.alias("grade"))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal | None:
    """Weights from at most ``rows`` labelled documents; None unless poor and good ones are among them."""
    sample = labelled_sample(graded(labels), documents, rows, ["grade"])
    found = mapped(sample.select("doc_id", "grade", "text"), _featured, "doc_id long, grade int, at array<smallint>, value array<float>").toPandas()
    found = found.sort_values("doc_id", ignore_index=True)  # a row for each id
    grade = found["grade"].to_numpy(np.int64)
    if not len(grade) or grade.min() > 0 or grade.max() == 0:
        return None
    x = np.zeros((len(found), (1 << BITS) + MARKERS), np.float32)
    for i, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[i, np.asarray(at, np.int64)] = value
    return fit_ordinal(x, grade)


def tails(text: Column, model: Ordinal | None) -> Column:
    """The tail probabilities of a column of texts, as an array from grade 1 up."""

    def worked(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts = [np.zeros((0, GRADES - 1))]
            for run in runs_of(texts, ROWS):
                found = model.tails(hashed(run)) if model else np.ones((len(run), GRADES - 1))
                found[np.diff(run.offsets) == 0] = 0.0
                parts.append(found)
            flat = np.concatenate(parts)
            yield pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * (GRADES - 1), pa.array(flat.ravel()))

    def graded_texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidied(worked(arrays))

    return F.arrow_udf(graded_texts, "array<double>")(text)


def select_quality(documents: DataFrame, model: Ordinal | None, least: float = 0.5) -> DataFrame:
    """The rows, with their own columns, whose chance of good quality is ``least`` or more."""
    small_batches(documents.sparkSession)
    return documents.filter(tails(F.col("text").cast("string"), model)[0] >= least)


def grade(documents: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, p_good, p_best, expected_grade) of every row."""
    small_batches(documents.sparkSession)
    found = documents.select(F.col("doc_id").cast("long"), tails(F.col("text").cast("string"), model).alias("p"))
    return found.select("doc_id", F.col("p")[0].alias("p_good"), F.col("p")[1].alias("p_best"), (F.col("p")[0] + F.col("p")[1]).alias("expected_grade"))


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = grade(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_good", "p_best", (F.col("p_good") >= 0.5).alias("kept"))
