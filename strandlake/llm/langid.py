"""Operator 2: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector is the
elementwise product (binding) of its letters' vectors, each permuted by its
place; a document's vector is the sum (bundle) of its n-grams' vectors. A
language's prototype is the bundle of its training documents, and a document
goes to the prototype with the greatest cosine.

Bundling is linear, so a document's vector is its n-gram counts times the table
of n-gram vectors, and the prototypes need the counts by language only, which
partitions add up before any shuffle.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing was learnt; repeated rows come back as often as they stand;
ties go to the first language by name; rows with a null lang teach nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import held_out, mapped, table
from strandlake.llm.words import runs

SYMBOLS = 32
GRAM = 3
DIMENSIONS = 1024
SEED = 20240
UNKNOWN = "und"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 for no letter, 1 to 26 for a to z, five more for the other letters."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and ch.isalpha():
            low = ch.lower()[:1]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
    return out


def symbols(text: str) -> np.ndarray:
    """The text as symbols, a single 0 for each stretch without letters, and one at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = _symbols()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        found = np.where(high, [27 + int(p) % 5 if chr(int(p)).isalpha() else 0 for p in points], found).astype(np.uint8)
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return np.concatenate([[0], found[keep], [0]])


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as numbers, and their counts."""
    s = symbols(text).astype(np.int32)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    counts = np.bincount(code, minlength=SYMBOLS**GRAM)
    at = np.flatnonzero(counts)
    return at, counts[at]


@lru_cache(2)
def vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The bound vector of every n-gram: fixed by the alphabet, the dimensions and the seed."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    out = np.ones((1, dimensions), np.int8)
    for place in range(GRAM):
        turned = np.roll(letters, GRAM - 1 - place, axis=1)
        out = (out[:, None, :] * turned[None, :, :]).reshape(-1, dimensions)
    return out


def bundle(at: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    return counts.astype(np.float32) @ vectors(dimensions)[at].astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition, added up."""
    total: dict[str, np.ndarray] = {}
    for run in runs(batches):
        langs = run.batch.column(0).to_pylist()
        for i, lang in enumerate(langs):
            at, counts = profile(run.text(i))
            if lang not in total:
                total[lang] = np.zeros(SYMBOLS**GRAM, np.int64)
            total[lang][at] += counts
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "gram", "n"])


def learn(documents: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes of unit length, from (text, lang); rows without a lang are left out.

    What reaches the driver is a count for each language and n-gram of a fixed
    alphabet, whatever the number of documents.
    """
    counts = mapped(documents.filter("lang is not null").select("lang", "text"), _counted, "lang string, gram int, n long")
    found = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    protos = np.zeros((len(langs), dimensions), np.float32)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        one = bundle(own["gram"].to_numpy(), own["n"].to_numpy(), dimensions)
        protos[i] = one / (np.linalg.norm(one) or 1)
    return langs, protos


def _told(batches: Iterator[pa.RecordBatch], langs: list[str], protos: np.ndarray) -> Iterator[pa.RecordBatch]:
    dimensions = protos.shape[1]
    for run in runs(batches):
        names, scores = [], np.zeros(len(run))
        for i in range(len(run)):
            at, counts = profile(run.text(i))
            name = UNKNOWN
            if len(at) and langs:
                one = bundle(at, counts, dimensions)
                cosine = protos @ one / (np.linalg.norm(one) or 1)
                best = int(cosine.argmax())
                name, scores[i] = langs[best], max(0.0, min(1.0, float(cosine[best])))
            names.append(name)
        yield pa.RecordBatch.from_arrays([run.batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(documents: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone."""
    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), partial(_told, langs=langs, protos=protos), "doc_id long, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    langs, protos = learn(documents.filter(~held_out(F.col("doc_id"))))
    return predict(documents, langs, protos).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
