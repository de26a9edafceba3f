"""Operator 10: token ids of a corpus in compressed, checksummed block files.

Texts are ordered by doc_id over range partitions of about ``FILE_BYTES`` of
text; each partition is one file, a row for each block: (part, block, first,
documents, payload). ``first`` is the number of ids before the block in its
file, ``documents`` lists the documents with ids in the block and how many,
``payload`` holds the ids, coded by the adaptive range coder. Every text is
followed by the end id. Blocks are read in any order and on any task, without
moving them; what a document has in several blocks is put together from the
lengths and checksums of its parts. So memory is bounded by a group of blocks,
whatever the size of a document.

Defined results: null and empty texts hold the end id alone; repeated rows are
written as often as they stand, in the order of their text's hash; rows with a
null doc_id come first; one id that many rows share is spread over several
files; an empty table gives an empty result; a damaged block raises ValueError;
further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import mapped, shared_dir, stored, table, text_hash
from strandlake.llm.rangecoder import BLOCK_IDS, LANES, decode_blocks, encode_blocks
from strandlake.llm.tokens import kept_encoder, tokenizer_path
from strandlake.llm.words import runs

END = 2
VOCABULARY = 50_257
#: Text of one file, about.
FILE_BYTES = 32 << 20

_DOCUMENTS = pa.list_(pa.struct([("number", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ends", pa.bool_())]))
BLOCKS = "part int, block int, first long, documents array<struct<number:long,doc_id:long,n:long,ends:boolean>>, payload binary"
_PIECES = "part int, number long, doc_id long, block int, begin long, n long, crc long, whole boolean"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())


class _Writer:
    """Cuts a file's ids into blocks and keeps count of the documents in them."""

    def __init__(self, part: int, vocabulary: int) -> None:
        self.part, self.vocabulary = part, vocabulary
        self.block = self.first = self.number = 0
        self.rest: list[np.ndarray] = []  # ids that fill no group of blocks yet
        self.held = 0
        self.docs: list[tuple[int, int | None, int]] = []  # documents and how many of their ids are still to be written

    def add(self, ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.docs += zip(range(self.number, self.number + len(doc_ids)), doc_ids, counts)
        self.number += len(doc_ids)

    def _listed(self, n: int) -> list[tuple]:
        """The documents of the next n ids."""
        entries, place = [], 0
        while n:
            number, doc, size = self.docs[place]
            take = min(n, size)
            entries.append((number, doc, take, take == size))
            n -= take
            if take == size:
                place += 1
            else:
                self.docs[place] = (number, doc, size - take)
        del self.docs[:place]
        return entries

    def blocks(self, last: bool) -> Iterator[pa.RecordBatch]:
        """A pass of blocks, or all that is left."""
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int32)
        n = len(ids) if last else LANES * BLOCK_IDS
        if n:
            group = [ids[i : min(i + BLOCK_IDS, n)] for i in range(0, n, BLOCK_IDS)]
            first = self.first + np.cumsum([0, *map(len, group)])
            columns = [
                pa.array([self.part] * len(group), pa.int32()),
                pa.array(range(self.block, self.block + len(group)), pa.int32()),
                pa.array(first[:-1]),
                pa.array([self._listed(len(b)) for b in group], _DOCUMENTS),
                pa.array(encode_blocks(group, self.vocabulary), pa.binary()),
            ]
            self.block, self.first = self.block + len(group), int(first[-1])
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "first", "documents", "payload"])
        self.rest, self.held = [ids[n:].copy()], len(ids) - n


def _written(batches: Iterator[pa.RecordBatch], path: str, end: int, vocabulary: int) -> Iterator[pa.RecordBatch]:
    own, out = kept_encoder(path), _Writer(TaskContext.get().partitionId(), vocabulary)
    for run in runs(batches):
        ids, counts = own.encode(run)
        out.add(np.insert(ids, np.cumsum(counts), np.int32(end)), run.batch.column(0).to_pylist(), (counts + 1).tolist())
        while out.held >= 2 * LANES * BLOCK_IDS:
            yield from out.blocks(False)
    yield from out.blocks(True)


def write(documents: DataFrame, folder: str, path: str | None = None, end: int = END, vocabulary: int = VOCABULARY, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all rows (doc_id, text) in ascending doc_id order; ``folder`` must be new.

    There is a file for each ``file_bytes`` of text, and one at least for each task that
    the session can run at once, down to files of a megabyte of text.
    """
    size = int(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(size // file_bytes, min(size >> 20, documents.sparkSession.sparkContext.defaultParallelism)) + 1
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]  # rows that are equal in all else are told apart by their place, so that any range can be cut
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = mapped(ordered, partial(_written, path=path or tokenizer_path(), end=end, vocabulary=vocabulary), BLOCKS)
    blocks.write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each document has in each block, about ``LANES`` blocks at a time."""
    held: list[pa.RecordBatch] = []

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        n = rows.num_rows if held else 0
        n = n if last else LANES
        if n:
            batch = rows.slice(0, n).to_pydict()
            out: list[tuple] = []
            for part, block, first, entries, ids in zip(*(batch[c] for c in ("part", "block", "first", "documents")), decode_blocks(batch["payload"])):
                raw, at = memoryview(np.ascontiguousarray(ids).astype("<u4").tobytes()), 0
                for i, e in enumerate(entries):
                    m = e["n"]
                    # the last of a block goes on if it doesn't end there, the first may have begun before
                    whole = e["ends"] and (i > 0 or first == 0)
                    out.append((part, e["number"], e["doc_id"], block, first + at, m, zlib.crc32(raw[4 * at : 4 * (at + m)]), whole))
                    at += m
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _KINDS)], [f.split()[0] for f in _PIECES.split(", ")])
        held[:] = rows.slice(n).to_batches() if held else []

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= 2 * LANES:
            yield from work(False)
    yield from work(True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from their pieces, which come in order. A checksum over more bytes is that of the bytes so far, moved on
    by as many zeros, added to that of the new ones: checksums are linear."""
    now: list | None = None
    for batch in batches:
        out: list[list] = []
        for part, number, doc, _, begin, n, crc, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and now[:2] == [part, number]:
                zeros = bytes(4 * n)
                now[4] += n
                now[5] = crc ^ zlib.crc32(zeros, now[5]) ^ zlib.crc32(zeros)
            else:
                if now is not None:
                    out.append(now)
                now = [part, number, doc, begin, n, crc]
        yield _documents(out)
    if now is not None:
        yield _documents([now])


def _documents(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in zip((0, 2, 3, 4, 5), kinds)], ["part", "doc_id", "begin", "n", "crc"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder."""
    files = spark.read.schema(BLOCKS).parquet(folder)
    pieces = stored(mapped(files, _decoded, _PIECES), "token-pieces")
    order = ["part", "number", "block"]
    parts = pieces.filter("not whole").repartition("part", "number").sortWithinPartitions(*order)
    found = pieces.filter("whole").select("part", "doc_id", "begin", "n", "crc").unionByName(mapped(parts, _joined, "part int, doc_id long, begin long, n long, crc long"))
    sizes = pieces.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offset = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return found.join(offset, "part").select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/strandlake/tokens-{uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
