"""Operator 6: packing into optimal length buckets.

Every text is measured in tokens, with one for its end; texts of more than
``MAX_LENGTH`` tokens are cut into pieces of that length and a rest, so that a
piece never exceeds it and nothing is lost. The histogram of all pieces' lengths
(``MAX_LENGTH`` numbers at most) goes to a dynamic program that finds the bucket
boundaries with the least padding over the whole corpus. Inside each bucket,
pieces are numbered and every ``budget // boundary`` of them make a batch, so
that a padded batch keeps to the token budget.

Defined results: null and empty texts are one piece with the end token alone; a
text of any length is measured whole and cut; repeated rows are packed as often
as they stand, in any order among them; a null doc_id is kept; an empty table
gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import mapped, stored, table
from strandlake.llm.tokens import TOKEN_BYTES, PieceEncoder, tokenizer_path
from strandlake.llm.words import runs

MAX_LENGTH = 4096
BUCKETS = 16
#: Tokens of a batch, padding included.
BUDGET = 65_536
#: Pieces of a bucket that are numbered together, about.
SLICE_ROWS = 20_000


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = PieceEncoder(path)  # for this task: a worker stays, and should hold nothing
    for run in runs(batches, limit=TOKEN_BYTES):
        yield pa.RecordBatch.from_arrays([run.batch.column(0), pa.array(own.count(run) + 1)], ["doc_id", "n_tokens"])


def lengths(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, the end token included."""
    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), partial(_lengths, path=path or tokenizer_path()), "doc_id long, n_tokens long")


def pieces(measured: DataFrame, most: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, piece, start, length): each text cut after every ``most`` tokens."""
    n = F.ceil(F.col("n_tokens") / most).cast("int")
    out = measured.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return out.select("doc_id", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(most)).cast("int").alias("length"))


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` upper bounds, the greatest length among them, with the least total padding.

    Ties take the lower boundaries. ``histogram`` has the number of pieces by length.
    """
    size = np.array(sorted(histogram), np.int64)
    if not len(size):
        return []
    n = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in size])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum([int(x) * histogram[int(x)] for x in size])]).astype(np.int64)
    m = len(size)
    far = np.int64(1) << np.int64(61)
    best = np.full(m + 1, far)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, m)):
        now, choice = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        for s in range(1, m + 1, 256):  # rows of 256 ends at a time
            j = np.arange(s, min(s + 256, m + 1))
            cost = size[j - 1][:, None] * (n[j][:, None] - n[None, :]) - (tokens[j][:, None] - tokens[None, :]) + best[None, :]
            cost[np.arange(m + 1)[None, :] >= j[:, None]] = far
            choice[j] = cost.argmin(1)
            now[j] = np.minimum(cost[np.arange(len(j)), choice[j]], far)
        choices.append(choice)
        done = best[m] <= now[m]
        best = now
        if done and len(choices) > 1:
            choices.pop()
            break
    out, j = [], m
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(size[j - 1]))
        j = int(choice[j])
    return out[::-1]


def batched(cut: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, salt) with bucket_len, batch, slot and padding.

    A bucket may hold most of the rows, so it is numbered by slices of a hash of
    the id; only the slices' sizes are added up over a bucket.
    """
    seen = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # MAX_LENGTH rows at most
    bounds = boundaries({r["length"]: r["n"] for r in seen}, buckets)
    slices = max(1, -(-sum(r["n"] for r in seen) // slice_rows))
    bucket = sum((F.col("length") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    bound = F.element_at(F.array(*(F.lit(b) for b in bounds or [1])), F.col("bucket") + 1)
    # rows of one id (or of none) are parted by a salt, which the stored table keeps
    placed = cut.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(slices)))
    sizes = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "salt")
    numbered = placed.withColumn("rank", F.row_number().over(order) - 1).join(offset, ["bucket", "slice"])
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / bound)).cast("long")
    place = F.col("rank") + F.col("offset")
    return numbered.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").alias("n_tokens"),
        bound.alias("bucket_len"),
        F.floor(place / per).cast("long").alias("batch"),
        F.pmod(place, per).cast("int").alias("slot"),
        (bound - F.col("length")).alias("padding"),
    )


def pack(documents: DataFrame, most: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, path: str | None = None) -> DataFrame:
    """A row per piece of every document, with its bucket, the batch in the bucket, the slot in the batch and its padding."""
    salted = pieces(lengths(documents, path), most).withColumn("salt", F.monotonically_increasing_id())
    return batched(stored(salted, "pieces"), buckets, budget)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
