"""Vectorised word splitting and hashing over Arrow text columns.

Everything here works on the raw UTF-8 bytes of a run of documents at once, so
a task handles about ``CHUNK_BYTES`` of text and at most ``CHUNK_ROWS`` rows per
numpy pass; a longer document makes a run of its own, for which a task needs
some twenty bytes for each of the text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 4096
U64 = np.uint64

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: bytes of [^\x20\x09-\x0D]
NON_SPACE = ~_SPACE
#: bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), so that all bits of a polynomial hash count."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Spans of more bytes than this are hashed one by one.
_LONG = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number, zeros beyond its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), U64, padded.data, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each data[start:end], equal for equal contents wherever they stand.

    Spans of up to eight bytes and one length never collide; longer ones are
    mixed eight bytes at a time, and those over ``_LONG`` bytes are XXH3's.
    """
    size = ends - starts
    out = mix(size.astype(U64) * _BASE + U64(seed))
    loads = eights(data)
    on = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(on):
        left = size[on] - at
        out[on] = mix(out[on] ^ (loads[starts[on] + at] & _LOW_BYTES[np.minimum(left, 8)]))
        on = on[left > 8]
        at += 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


@dataclass
class Run:
    """Consecutive rows of a batch with their text bytes."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def row_hash(self) -> np.ndarray:
        """A hash of each whole text."""
        return span_hash(self.data, self.offsets[:-1], self.offsets[1:])


def runs_of(texts: pa.Array, rows: int = CHUNK_ROWS) -> Iterator[Run]:
    """The runs of a single column of texts."""
    return runs(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), rows=rows)


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Run]:
    """Cut Arrow batches into runs of about ``limit`` bytes of text and ``rows`` rows at most, whole rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + rows, len(texts))
            yield Run(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


@dataclass
class Words:
    """Word spans of a run: byte starts and ends, the row of each, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def index(self) -> np.ndarray:
        """Position of each word in its own document."""
        return np.arange(len(self.row)) - self.first[self.row]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(run: Run, kind: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal stretches of bytes in ``kind``; they never cross a row."""
    data = run.data if data is None else data
    n, offsets = len(data), run.offsets
    inside = kind[data] if n else np.zeros(0, bool)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(starts, ends, row, first)


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries (rolling over the whole array)."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, U64(salt * 2 + 1))
    for j in range(k):
        total = total * _BASE + hashes[j : j + n]
    return mix(total)


def same_row(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each position lie in one row."""
    n = max(0, len(words.row) - k + 1)
    return words.row[:n] == words.row[k - 1 :][:n]


def per_row(values: np.ndarray, words: Words) -> np.ndarray:
    """Sum of a value of each word over each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[words.first[1:]] - sums[words.first[:-1]]


def laid(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """data[start:end] of all, one after the other, with ``lead`` blanks before each, and their offsets."""
    size = ends - starts + lead
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - lead - offsets[:-1], size) + np.arange(offsets[-1])
    if not lead:
        return data[at], offsets
    out = data[np.maximum(at, 0)]
    out[offsets[:-1]] = 32
    return out, offsets
