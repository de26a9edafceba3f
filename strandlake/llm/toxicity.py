"""Operator 9: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts the three-letter subsequences (word ends
included) they share, each weighted by ``DECAY`` to the power of its span in
both, so that a gap or an inserted character costs a factor rather than the
match. A bounded sample of labelled documents teaches it: all their words inherit
the labels of their sentences, landmarks are the words that lean most to either
side, the kernel with the landmarks is whitened (Nyström) and a linear support
vector machine is trained on it by Newton steps, whose sums over the words are
taken by Spark. The machine's sum over the landmarks is linear
in the subsequence weights of a word, so it is folded into one table by
subsequence, and every word of every whole text is scored by looking up its
subsequences. A logistic step turns the decisions on a document's words into a
margin, and isotonic calibration turns that into its score.

Marks inside words are dropped, digits read as the letters they stand for, and
runs of single letters joined ("i d i o t") before scoring.

Defined results: a text that is null, empty or without words gets the score of
a document with no toxic word; texts and words of any length are read whole;
without labels of both classes every score is 0; labels of one document that
contradict each other count as toxic; repeated rows come back as often as they
stand, those of a null doc_id too; ties between landmarks go by name; an empty
table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import dropped, held_out, labelled_sample, mapped, stored, table
from strandlake.llm.words import Run, runs

#: Labelled documents that the machine is trained on, at most; two thirds teach the words, the rest the documents' step.
FIT_ROWS = 8000
LANDMARKS = 768
#: Newton steps at most, tasks that take their sums, words side by side in one, and letters of a word that takes a pass of its own.
STEPS, PARTS, TOGETHER, LONG = 6, 6, 500, 64
DECAY = 0.7
RIDGE = 1e-7
#: Weight of words that lean to toxic documents, for each standard deviation that they do.
GAIN = 1.0
SPAN = 5  # letters from the first of a subsequence to its last, less one
SYMBOLS = 32
TABLE = SYMBOLS**3
PREDICT_AT = 0.7

_DROP, _END = 255, 0
#: Letters that digits and marks stand for.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    out = np.full(0x10000, _DROP, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if ch.isspace():
            out[c] = _END
        elif ch.isalpha() or ch in _STANDS_FOR:
            low = _STANDS_FOR.get(ch, ch.lower()[:1])
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
    return out


@dataclass
class Stream:
    """The words of a run as symbols with an end mark on both sides of each."""

    x: np.ndarray
    begins: np.ndarray  # of each word, the place of the mark before it
    sizes: np.ndarray
    row: np.ndarray  # of each word


def stream(run: Run) -> Stream:
    points = np.frombuffer(run.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum((run.data & 0xC0) != 0x80, out=chars[1:])
    starts = chars[run.offsets[:-1]]
    s = _symbol_table()[np.minimum(points, 0xFFFF)]
    # each row begins with a mark that no rule takes away
    s = np.insert(s, starts, np.uint8(_END))
    edge = np.zeros(len(s), bool)
    edge[starts + np.arange(len(starts))] = True
    row = np.cumsum(edge) - 1
    kept = s != _DROP
    s, edge, row = s[kept], edge[kept], row[kept]
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == _END) & (s[:-1] == _END)
    # of a stretch of marks the last stays, so that a row's own mark wins over what came before it
    last = np.ones(len(s), bool)
    last[:-1] = ~again[1:]
    carries = np.flatnonzero((s == _END) & last)
    first = np.flatnonzero((s == _END) & ~again)
    edge_at = np.add.reduceat(edge.astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    keep = (s != _END) | last
    new_edge = np.zeros(len(s), bool)
    new_edge[carries] = edge_at
    s, edge, row = s[keep], new_edge[keep], row[keep]
    marks = np.flatnonzero(s == _END)
    sizes = np.diff(np.append(marks, len(s))) - 1
    if len(marks) > 1:  # join runs of single letters
        between = (sizes[:-1] == 1) & (sizes[1:] == 1) & ~edge[marks[1:]]
        keep = np.ones(len(s), bool)
        keep[marks[1:][between]] = False
        s, edge, row = s[keep], edge[keep], row[keep]
        marks = np.flatnonzero(s == _END)
    x = np.append(s, np.uint8(_END))
    sizes = np.diff(np.append(marks, len(s))) - 1
    some = sizes > 0
    return Stream(x, marks[some], sizes[some], row[marks[some]] if len(marks) else np.zeros(0, np.int64))


@lru_cache(4)
def _norms(longest: int) -> np.ndarray:
    """Length of a word's subsequence weights, by its letters, as if no subsequence stood twice in it."""
    n = np.arange(longest + 1)
    square = sum(np.maximum(0, n + 2 - d) * (d - 1) * DECAY ** (2 * d) for d in range(2, SPAN + 1))
    return np.sqrt(np.maximum(square, 1e-12))


def _subsequences(words: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places of the last letter, subsequence numbers, weight) for each shape of gap."""
    x = words.x.astype(np.int32)
    marks = np.cumsum(x == _END)
    n = len(x)
    for d in range(2, SPAN + 1):
        if n <= d:
            break
        at = np.flatnonzero(marks[d - 1 : n - 1] == marks[: n - d]) + d
        outer = x[at - d] * (SYMBOLS * SYMBOLS) + x[at]
        for j in range(1, d):
            yield at, outer + x[at - j] * SYMBOLS, DECAY**d


def decisions(words: Stream, weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sum of the weights of each word's subsequences, over its length; weights may have several columns, and ``rows`` their row for each subsequence."""
    total = np.zeros((len(words.x), *weights.shape[1:]), np.float32)
    for at, code, w in _subsequences(words):
        total[at] += np.float32(w) * weights[code if rows is None else rows[code]]
    if not len(words.begins):
        return np.zeros((0, *weights.shape[1:]), np.float32)
    ends = words.begins + words.sizes + 2
    sums = np.add.reduceat(total, np.stack([words.begins + 1, np.minimum(ends, len(words.x) - 1)], 1).ravel(), axis=0)[::2]
    # the last word's end mark is the last place of all
    if ends[-1] > len(words.x) - 1:
        sums[-1] = total[words.begins[-1] + 1 :].sum(0)
    norm = _norms(int(words.sizes.max()))[words.sizes]
    return sums / (norm[:, None] if weights.ndim > 1 else norm)


def _stream_of(words: list[str]) -> Stream:
    """A stream of given words, written in symbols' letters (chr of 96 + symbol)."""
    sizes = np.array([len(w) for w in words], np.int64)
    x = np.frombuffer(("`" + "`".join(words) + "`").encode("latin-1"), np.uint8) - 96
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return Stream(x, begins, sizes, np.zeros(len(words), np.int64))


def document_features(words: Stream, f: np.ndarray, rows: int) -> np.ndarray:
    """Of each row: the greatest decisions on its words, how many decide for toxic, and their share."""
    n = np.bincount(words.row, minlength=rows)
    order = np.lexsort((-f, words.row))
    place = np.arange(len(f)) - (np.cumsum(n) - n)[words.row[order]]
    top = np.full((rows, 5), -1.0)
    first = place < 5
    top[words.row[order][first], place[first]] = np.clip(f[order][first], -1.0, 1.5)
    over = np.bincount(words.row, f > 0, rows)
    total = np.bincount(words.row, np.clip(f + 0.3, 0, 1.5), rows)
    return np.stack([top[:, 0], top[:, 1], top[:, 2], top[:, 4], np.log1p(over), np.log1p(total), np.log1p(total) - 0.5 * np.log1p(n)], 1)


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    step: np.ndarray
    offset: float
    knots: tuple[np.ndarray, np.ndarray]  # margins, rising, and the chance at each

    def margin(self, run: Run) -> np.ndarray:
        words = stream(run)
        x = document_features(words, decisions(words, self.weights) + self.bias, len(run))
        return ((x - self.centre) / self.scale) @ self.step + self.offset

    def score(self, run: Run) -> np.ndarray:
        return np.interp(self.margin(run), *self.knots)


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps of the chance over the margin (pooled neighbours), as the knots of a rising line.

    Each step has two knots, its ends; half a row of either class is added to a
    step, so that no chance is 0 or 1.
    """
    order = np.lexsort((y, margin))
    steps: list[list[float]] = []  # rows, toxic rows, first margin, last margin
    for m, t in zip(margin[order].tolist(), y[order].tolist()):
        steps.append([1.0, t, m, m])
        while len(steps) > 1 and (steps[-2][1] / steps[-2][0] >= steps[-1][1] / steps[-1][0] or steps[-2][3] == steps[-1][2]):
            n, k, _, last = steps.pop()
            steps[-1] = [steps[-1][0] + n, steps[-1][1] + k, steps[-1][2], last]
    chance = np.maximum.accumulate([(k + 0.5) / (n + 1) for n, k, _, _ in steps])
    return np.array([x for s in steps for x in s[2:]]), np.repeat(chance, 2)


def _adam(slope, size: int, steps: int, rate: float) -> np.ndarray:
    state, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, steps + 1):
        g = slope(state)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state = state - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return state


@dataclass
class Landmarks:
    """The landmarks' subsequences: number, landmark and weight of each, over the landmark's length."""

    code: np.ndarray
    of: np.ndarray
    weight: np.ndarray
    n: int

    @classmethod
    def from_words(cls, words: list[str]) -> Landmarks:
        marks = _stream_of(words)
        of = np.repeat(np.arange(len(marks.sizes)), marks.sizes + 1)  # of each place after a word's first mark
        norm = _norms(int(marks.sizes.max()))[marks.sizes]
        parts = [(code, of[at - 1], w / norm[of[at - 1]]) for at, code, w in _subsequences(marks)]
        key = np.concatenate([c.astype(np.int64) * len(words) + o for c, o, _ in parts])
        held, place = np.unique(key, return_inverse=True)
        return cls(held // len(words), held % len(words), np.bincount(place, np.concatenate([w for _, _, w in parts])), len(words))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each subsequence and the rows (landmarks wide); the last row, of zeros, is for those in no landmark."""
        used, row = np.unique(self.code, return_inverse=True)
        rows = np.full(TABLE, len(used), np.int64)
        rows[used] = np.arange(len(used))
        table = np.zeros((len(used) + 1, self.n), np.float32)
        table[row, self.of] = self.weight
        return rows, table

    def whitening(self) -> np.ndarray:
        _, table = self.table()
        values, vectors = np.linalg.eigh(table.T @ table + 1e-3 * np.eye(self.n))
        return ((vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T).astype(np.float32)


class Kernels:
    """The kernel of words with the landmarks: only what a word's subsequences have in landmarks is gone through."""

    def __init__(self, marks: Landmarks) -> None:
        self.rows, self.table = marks.table()
        row = self.rows[marks.code]
        order = np.argsort(row, kind="stable")
        self.of, self.weight = marks.of[order], marks.weight[order]
        self.first = np.searchsorted(row[order], np.arange(len(self.table)))  # of each row, its first landmark; the last row has none
        self.many = np.bincount(row, minlength=len(self.table))

    def of_short(self, words: list[str]) -> np.ndarray:
        marks, n = _stream_of(words), self.table.shape[1]
        word = np.repeat(np.arange(len(words)), marks.sizes + 1)  # of each place after a word's first mark
        parts = [(word[at - 1], self.rows[code], np.full(len(at), w)) for at, code, w in _subsequences(marks)]
        word, row, weight = (np.concatenate(x) for x in zip(*parts))
        met = self.many[row]
        place = np.repeat(self.first[row] - (np.cumsum(met) - met), met) + np.arange(int(met.sum()))
        found = np.bincount(np.repeat(word * n, met) + self.of[place], np.repeat(weight, met) * self.weight[place], len(words) * n)
        return found.reshape(-1, n) / _norms(int(marks.sizes.max()))[marks.sizes][:, None]

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, landmarks)."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for s in range(0, len(short), TOGETHER):
            some = short[s : s + TOGETHER]
            out[some] = self.of_short([words[i] for i in some])
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            one = _stream_of([words[i]])
            total = np.zeros(len(self.table))
            for _, code, w in _subsequences(one):
                total += w * np.bincount(self.rows[code], minlength=len(self.table))
            out[i] = total @ self.table / _norms(int(one.sizes[0]))[one.sizes[0]]
        return out


def _newton(batches: Iterator[pa.RecordBatch], marks: Landmarks, folded: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    """The sums (square, pull) of a Newton step of the squared hinge over rows (word, toxic, clean), the latter two weights:
    of the words inside the margin by their kernels with the landmarks. ``folded`` and ``bias`` decide on a word so far."""
    kernels = Kernels(marks)
    square, pull = np.zeros((marks.n + 1, marks.n + 1)), np.zeros(marks.n + 1)
    for batch in batches:
        for s in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(s, TOGETHER)
            words = part.column(0).to_pylist()
            f = decisions(_stream_of(words), folded) + bias
            a, c = part.column(1).to_numpy() * (f < 1), part.column(2).to_numpy() * (f > -1)
            inside = np.flatnonzero(a + c)
            if not len(inside):
                continue
            a, c = a[inside], c[inside]
            x = np.ones((len(inside), marks.n + 1), np.float32)
            x[:, :-1] = kernels([words[i] for i in inside.tolist()])
            pull += x.T @ (a - c)
            x *= np.sqrt(a + c).astype(np.float32)[:, None]
            square += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()], pa.binary()), pa.array([pull.tobytes()], pa.binary())], ["square", "pull"])


def train_words(words: DataFrame, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float] | None:
    """The folded table and bias, from words (word, toxic, clean: documents that hold it); None without both classes.

    What reaches the driver are the landmarks and, for each step, sums of a fixed size.
    """
    toxic, clean = words.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return None
    prior, n = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    lean = (F.col("toxic") - n * prior) / F.sqrt(n * (prior * (1 - prior)))
    leaning = words.withColumn("lean", lean)
    up = [r["word"] for r in leaning.filter("lean > 0").orderBy(F.desc("lean"), "word").limit(landmarks * 2 // 3).collect()]
    down = [r["word"] for r in leaning.filter("lean <= 0").orderBy(F.desc("clean"), "word").limit(landmarks - len(up)).collect()]
    marks = Landmarks.from_words(up + down)
    whiten = marks.whitening()
    root = F.sqrt(n)  # or else the commonest words are all that counts
    weighed = leaning.select("word", (F.col("toxic") * F.when(F.col("lean") > 2, 1 + GAIN * F.col("lean")).otherwise(1.0) / root).alias("toxic"), (F.col("clean") / root).alias("clean"))
    weighed = stored(weighed.repartition(PARTS, "word").sortWithinPartitions("word"), "toxic-words")
    total = weighed.agg(F.sum((F.col("toxic") + F.col("clean")).cast("decimal(28,9)"))).first()[0]
    held = np.diag(np.append(np.full(marks.n, RIDGE), 1e-9))
    state = np.zeros(marks.n + 1)
    rows, table = marks.table()
    fold = lambda state: (table @ (whiten @ state[:-1]).astype(np.float32))[rows]
    white = np.eye(marks.n + 1)  # takes sums over kernels to those over whitened ones
    white[:-1, :-1] = whiten
    # however many files there are, no more sums reach the driver than from PARTS tasks
    weighed_in_parts = weighed.coalesce(PARTS)
    for _ in range(STEPS):  # exact once the same words are inside the margin
        sums = mapped(weighed_in_parts, partial(_newton, marks=marks, folded=fold(state), bias=float(state[-1])), "square binary, pull binary").collect()
        square = white @ (sum(np.frombuffer(r["square"]).reshape(marks.n + 1, -1) for r in sums) / float(total)) @ white + held
        now = np.linalg.solve(square, white @ (sum(np.frombuffer(r["pull"]) for r in sums) / float(total)))
        done = np.abs(now - state).max() < 1e-6
        state = now
        if done:
            break
    dropped(weighed)
    return fold(state), float(state[-1])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean) for each distinct word of each training document."""
    for run in runs(batches):
        words = stream(run)
        letters = (words.x + 96).tobytes().decode("latin-1")
        seen = {(r, letters[b + 1 : b + 1 + n]) for r, b, n in zip(words.row.tolist(), words.begins.tolist(), words.sizes.tolist()) }
        toxic = np.asarray(run.batch.column(1).to_pylist())
        rows = np.array([r for r, _ in seen], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in seen], pa.string()), pa.array(toxic[rows].astype(np.int64) if len(rows) else [], pa.int64())], ["word", "toxic"])


def _documents(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        words = stream(run)
        x = document_features(words, decisions(words, weights) + bias, len(run))
        yield pa.RecordBatch.from_arrays([run.batch.column(0), run.batch.column(1), pa.array(list(x))], ["doc_id", "toxic", "x"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine | None:
    """Train on at most ``rows`` labelled documents and all their words; None without both classes."""
    sample = labelled_sample(labels.filter("toxic is not null"), documents, rows, ["toxic"])
    sample = stored(sample.select("doc_id", F.col("toxic").cast("int"), "text"), "toxic-sample")
    first = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(3)) > 0
    counted = mapped(sample.filter(first), _word_rows, "word string, toxic long")
    counted = stored(counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "toxic-counts")
    trained = train_words(counted)
    if trained is None:
        return None
    weights, bias = trained
    seen = mapped(sample.filter(~first), partial(_documents, weights=weights, bias=bias), "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id")
    y = seen["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    x = np.stack(seen["x"].to_numpy())
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale

    def slope(state: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(z @ state[:-1] + state[-1], -50, 50)))
        return np.append(z.T @ (p - y) / len(y) + 1e-3 * state[:-1], (p - y).mean())

    state = _adam(slope, x.shape[1] + 1, 600, 0.05)
    return Machine(weights, bias, centre, scale, state[:-1], float(state[-1]), calibrated(z @ state[:-1] + state[-1], y))


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        score = machine.score(run) if machine else np.zeros(len(run))
        yield pa.RecordBatch.from_arrays([run.batch.column(0), pa.array(score)], ["doc_id", "score"])


def score(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row, from the text alone."""
    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), partial(_scored, machine=machine), "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
