"""Operator 3: quality rules and gradient-boosted trees over document statistics.

Statistics of every whole text (sizes, symbols, repeated lines and windows) feed
fixed rules and a boosted ensemble. The trees are grown on a bounded sample of
labelled documents by histogram splits with monotonic constraints, then
flattened into node arrays; scoring walks all trees of all rows at once.

Defined results: null and empty texts have no words and fail the rules; a text
of any length is measured whole; repeated rows come back as often as they stand,
those of a null doc_id too; labels of one document that contradict each other
count by their greatest value; without any labelled row the rules alone decide;
ties between splits go to the first feature and the lowest bin; an empty table
gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import labelled_sample, mapped, table
from strandlake.llm.words import NON_SPACE, U64, Run, Words, grams, mix, per_row, runs, same_row, span_hash, split

#: Labelled documents that the trees are grown on, at most.
FIT_ROWS = 6000
WINDOW = 5

#: Features, and the sign that the chance of quality must keep as each grows (0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "same_next_share": -1,
    "upper_share": -1,
    "digit_share": -1,
    "mark_share": 0,
    "short_word_share": 0,
    "words_per_line": 0,
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_NOT_WITHIN = (np.arange(256) & 0xC0) != 0x80


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key stands twice or more, and whether an equal one stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    out[order], later[order] = twice, same
    return out, later


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes + row.astype(U64) * U64(0xD1342543DE82EF95))


def _byte_counts(flags: np.ndarray, run: Run) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return (sums[run.offsets[1:]] - sums[run.offsets[:-1]]).astype(np.int64)


def _flag_rows(flags: np.ndarray, spans: Words) -> np.ndarray:
    return per_row(flags.astype(np.int64), spans)


def statistics(run: Run) -> dict[str, np.ndarray]:
    """Counts of each row of a run: the contract's statistics and those behind the features."""
    data = run.data
    words = split(run, NON_SPACE)
    hashes = span_hash(data, words.starts, words.ends)
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = _byte_counts(NON_SPACE[data] & _NOT_WITHIN[data], run)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digit", _DIGIT), ("n_mark", _MARK)):
        out[name] = _byte_counts(kind[data], run)
    lines = split(run, _NOT_NEWLINE)
    inside = np.zeros(len(data) + 1, np.int32)
    np.cumsum(NON_SPACE[data], out=inside[1:])
    worded = inside[lines.ends] > inside[lines.starts]
    lines_hash = _of_row(span_hash(data, lines.starts, lines.ends), lines.row)
    lines_hash[~worded] = mix(np.flatnonzero(~worded).astype(U64))  # lines without a word repeat nothing
    out["n_lines"] = _flag_rows(worded, lines)
    out["n_dup_lines"] = _flag_rows(_repeated(lines_hash)[1] & worded, lines)
    at = np.flatnonzero(same_row(words, WINDOW))
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        twice = at[_repeated(_of_row(grams(hashes, WINDOW)[at], words.row[at]))[0]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = _flag_rows(np.cumsum(covered)[:-1] > 0, words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    out["n_same_next"] = _flag_rows(same, words)
    out["n_short_words"] = _flag_rows(words.ends - words.starts <= 1, words)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    columns = {
        "log_words": np.log1p(s["n_words"]),
        "word_length": s["word_chars"] / words,
        "symbols_per_word": s["n_symbols"] / words,
        "dup_line_share": s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        "repeat_share": s["n_repeat_words"] / words,
        "same_next_share": s["n_same_next"] / words,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digit"] / chars,
        "mark_share": s["n_mark"] / chars,
        "short_word_share": s["n_short_words"] / words,
        "words_per_line": s["n_words"] / np.maximum(s["n_lines"], 1),
    }
    return np.stack([columns[f] for f in FEATURES], 1)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of the positive class for each row of x."""
        total = np.full(len(x), self.base)
        for s in range(0, len(x), 4096):
            part = x[s : s + 4096]
            node = np.repeat(self.roots[None, :], len(part), 0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[s : s + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boost ``trees`` trees on logistic loss; a split that breaks its feature's sign is not taken, and
    the children's values stay on their side of the middle, so that whole trees keep the signs."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        g, h = y - chance, chance * (1 - chance)

        def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
            here = len(nodes)
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
            nodes.append([0, np.inf, here, here, rate * value])
            best = None
            if level < depth and len(rows) >= 2 * least:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    b = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gl, hl, gr, hr = gs, hs + ridge, g[rows].sum() - gs, h[rows].sum() - hs + ridge
                    gain = gl**2 / hl + gr**2 / hr - whole
                    ok = (ns >= least) & (len(rows) - ns >= least) & (signs[f] * (gr / hr - gl / hl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    i = int(gain.argmax())
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], f, i, gl[i] / hl[i], gr[i] / hr[i])
            if best is None:
                leaves.append((rows, rate * value))
                return here
            _, f, i, vl, vr = best
            middle = float(np.clip((vl + vr) / 2, low, high))
            go = binned[rows, f] <= i
            bounds = [(low, high), (low, high)]
            if signs[f] > 0:
                bounds = [(low, middle), (middle, high)]
            elif signs[f] < 0:
                bounds = [(middle, high), (low, middle)]
            left = build(rows[go], level + 1, *bounds[0])
            right = build(rows[~go], level + 1, *bounds[1])
            nodes[here] = [f, edges[f][i], left, right, 0.0]
            return here

        leaves: list[tuple[np.ndarray, float]] = []
        roots.append(build(np.arange(len(y)), 0, -4.0, 4.0))
        for rows, value in leaves:
            margin[rows] += value
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), base, depth)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        x = features(statistics(run))
        yield pa.RecordBatch.from_arrays([run.batch.column(0), run.batch.column(1), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], ["doc_id", "label", *FEATURES])


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents; None without a label of each class."""
    sample = labelled_sample(labels.filter("quality is not null"), documents, rows, ["quality"])
    schema = "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    found = mapped(sample.select("doc_id", F.col("quality").cast("int"), "text"), _featured, schema).toPandas().sort_values("doc_id")
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    return grow(found[list(FEATURES)].to_numpy(float), y, list(FEATURES.values()))


def _ruled(batches: Iterator[pa.RecordBatch], trees: Trees | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        s = statistics(run)
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        score = trees.score(features(s)) if trees else 1.0 - failed
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays([run.batch.column(0), *(pa.array(s[n]) for n in names), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score.astype(float))], ["doc_id", *names, "base_failed", "kept", "score"])


def rules(documents: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """A row per document: the statistics, the fixed rules' verdict, the final one and the trees' chance of quality."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), partial(_ruled, trees=trees, threshold=threshold), schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rules(documents, fit(documents, table(spark, sf_dir, "labels")))
