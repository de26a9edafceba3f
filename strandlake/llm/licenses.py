"""Operator 1: licence scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of
the same k-grams in the templates. A hit votes for the diagonal (document
position less template position); the template's positions are gathered by
diagonal, neighbouring diagonals are merged, as a few words more or less shift a
quotation (every window of them is looked at, so that a stray hit nearby takes
nothing away), and a span counts once it is verified: every hit's second hash, of
words hashed with another seed, agrees, the distinct positions cover enough of
the template and the span is about as long.

Phrases are matched exactly: each diagonal that holds all k-grams of the phrase
is a place. Other templates need ``COVERAGE`` of their k-grams.

Defined results: null and empty texts have no words and no labels; a text of any
length is scanned whole; repeated rows come back as often as they stand; a null
doc_id is kept; ties between labels are sorted by name; an empty table gives an
empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.llm.common import stored, table
from strandlake.llm.words import ALNUM, LOWER, U64, Words, grams, runs, same_row, span_hash, split

GRAM = 2
#: Positions of a template in one number.
BITS = 62
COVERAGE = 0.85
#: Diagonals that spread no further than this may belong to one quotation.
NEIGHBOUR = 3

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short public licence notices and grants, and their labels.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "has waived all copyright and related or neighboring rights to this work under CC0 1.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool


TEMPLATES = [*(Template(label, phrase, True) for phrase, label in PHRASES.items()), *(Template(label, text, False) for label, text in NOTICES)]


def _hashed(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    return span_hash(data, words.starts, words.ends, seed)


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each k-gram, and one with pos -1 and the word count in ``h`` for each document."""
    for run in runs(batches):
        data = LOWER[run.data]
        words = split(run, ALNUM, data)
        hashes = _hashed(data, words)
        row_hash = run.row_hash().view(np.int64)
        ids = run.batch.column(0)
        at = np.flatnonzero(same_row(words, GRAM))
        h, check = grams(hashes, GRAM), grams(_hashed(data, words, 1), GRAM, salt=1)
        own = np.arange(len(run))
        for row, pos, key, other in ((own, np.full(len(run), -1), words.counts.astype(np.int64), np.zeros(len(run), np.int64)), (words.row[at], words.index[at], h[at].view(np.int64), check[at].view(np.int64))):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(row_hash[row]), pa.array(pos.astype(np.int32)), pa.array(key), pa.array(other)],
                ["doc_id", "row_hash", "pos", "h", "check"],
            )


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, at, h, check) for every k-gram of the templates: their number is fixed by the list."""
    rows = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(templates)), pa.int64()), pa.array([t.text for t in templates])], ["doc_id", "text"])
    for part in _document_grams([batch]):
        rows += [(t, p, h, c) for t, _, p, h, c in zip(*(x.to_pylist() for x in part.columns)) if p >= 0]
    return spark.createDataFrame(rows, "template int, at int, th long, tcheck long")


def spans(documents: DataFrame, templates: list[Template] = TEMPLATES, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """Verified spans (doc_id, row_hash, template, first, end, score) and rows (doc_id, row_hash, n_words, copies)."""
    spark = documents.sparkSession
    prints = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_document_grams, "doc_id long, row_hash long, pos int, h long, check long")
    placed = F.broadcast(template_grams(spark, templates))
    joined = prints.join(placed, (prints["h"] == placed["th"]) & (prints["pos"] >= 0), "left").filter("pos = -1 or check = tcheck")
    key = ["doc_id", "row_hash"]
    # the template's positions that were hit, as bits: repeated rows and neighbouring diagonals count each once
    parts = range(-(-max((_count(t.text) for t in templates), default=1) // BITS))
    seen = [F.bit_or(F.when(F.floor(F.col("at") / BITS) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % BITS))).alias(f"seen{i}") for i in parts]
    votes = joined.groupBy(*key, F.coalesce("template", F.lit(-1)).alias("template"), F.when(F.col("pos") >= 0, F.col("pos") - F.col("at")).otherwise(0).alias("diagonal")).agg(
        F.count("*").alias("copies"), *seen, F.min("at").alias("low"), F.max("at").alias("high"), F.max(F.when(F.col("pos") == -1, F.col("h"))).alias("n_words")
    )
    votes = stored(votes, "votes")
    rows = votes.filter("template = -1").select(*key, "n_words", "copies")
    voted = votes.filter("template >= 0").select(*key, "template", "diagonal", "low", "high", *(f"seen{i}" for i in parts))
    covered = lambda of: sum((F.coalesce(F.bit_count(of(f"seen{i}")), F.lit(0)) for i in parts), F.lit(0))
    size = F.create_map(*(F.lit(x) for i, t in enumerate(templates) for x in (i, _count(t.text))))[F.col("template")]
    exact = F.col("template").isin([i for i, t in enumerate(templates) if t.exact])
    voted = voted.withColumn("size", size).withColumn("exact", exact)
    cols = [*key, "template"]
    whole = voted.filter(F.col("exact") & (covered(F.col) >= F.col("size") - (GRAM - 1))).select(*cols, F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("score"))
    # every window of neighbouring diagonals, from each diagonal on; of those that begin near each other the best counts
    near = Window.partitionBy(*cols).orderBy("diagonal")
    window, around = near.rangeBetween(0, NEIGHBOUR), near.rangeBetween(-NEIGHBOUR, NEIGHBOUR)
    merged = (
        voted.filter(~F.col("exact"))
        .select(
            *cols,
            "diagonal",
            "size",
            covered(lambda c: F.bit_or(c).over(window)).alias("covered"),
            F.min(F.col("diagonal") + F.col("low")).over(window).alias("first"),
            (F.max(F.col("diagonal") + F.col("high")).over(window) + GRAM).alias("end"),
        )
        .withColumn("score", F.col("covered") / (F.col("size") - (GRAM - 1)))
        .filter((F.col("score") >= coverage) & (F.col("end") - F.col("first") <= 2 * F.col("size")))
        .withColumn("best", F.max(F.struct("covered", -F.col("diagonal"))).over(around))
        .filter(F.col("best") == F.struct("covered", -F.col("diagonal")))
        .select(*cols, "first", "end", "score")
    )
    return whole.unionByName(merged), rows


def _count(text: str) -> int:
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    return int(sum(split(run, ALNUM, LOWER[run.data]).counts.sum() for run in runs([batch])))


def scan(documents: DataFrame, templates: list[Template] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """A row per document: n_words, the places of the exact phrases, labels of both kinds and the best score."""
    found, rows = spans(documents, templates, coverage)
    label = F.create_map(*(F.lit(x) for i, t in enumerate(templates) for x in (i, t.label)))[F.col("template")]
    exact = F.col("template").isin([i for i, t in enumerate(templates) if t.exact])
    base = lambda c: F.when(exact, c)
    each = found.groupBy("doc_id", "row_hash").agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("first"))).cast("long").alias("first_word"),
        F.max(base(F.col("first"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(base(label))).alias("base_labels"),
        F.array_sort(F.collect_set(label)).alias("labels"),
        F.max("score").alias("score"),
        F.collect_set(F.struct("template", "first", "end")).alias("spans"),
    )
    out = rows.join(each, rows["doc_id"].eqNullSafe(each["doc_id"]) & (rows["row_hash"] == each["row_hash"]), "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    return out.select(
        rows["doc_id"],
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    ).drop("_copy")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
