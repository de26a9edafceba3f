"""Token ids of whole texts with a public tokenizer, each distinct piece of text encoded once.

A byte-level BPE never merges across the pieces that its pattern cuts a text
into, so the pieces of a run are found by numpy on code point classes, and only
pieces that a worker has not met go through the tokenizers library. Pieces are
told apart by their bytes. New pieces go to the library many at a time, a line
each: a line end is a piece of its own there, so its id parts theirs. Rows that
hold one of the tokenizer's added tokens or characters outside the
well-established blocks are encoded by the library as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers

from strandlake.llm.words import U64, Run, eights, mix

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of the pieces that stand in the table; with their length they fill two numbers.
_SHORT = 15
#: Text of one pass where memory is short: the library's answers take many times the text.
TOKEN_BYTES = 1 << 17
#: New pieces that go to the library as one text.
_TOGETHER = 200
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: The letters that an apostrophe takes along alone are s, t, m and d (and re, ve, ll).
_SINGLE = np.frombuffer("stmd".encode("utf-32-le"), np.uint32)
_SPACE, _LETTER, _NUMBER, _OTHER, _RARE = range(5)
#: Code points below this are cut by class; rows with others are encoded whole.
_KNOWN = 0x0500
#: Code points of the White_Space property below that, and the dashes and quotes of general punctuation kept as known.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x2100, _RARE, np.uint8)
    for c in [*range(_KNOWN), *range(0x2010, 0x2028)]:
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER if kind != "Cn" else _RARE
    out[_WHITE] = _SPACE
    return out


class PieceEncoder:
    """A tokenizer and the ids of the pieces met so far.

    Pieces of up to ``_SHORT`` bytes stand in an open-addressed table of numpy
    arrays, keyed by their bytes and length; longer ones in a dict. The table
    grows with use; once it holds ``most`` pieces, the next run starts it afresh.
    """

    def __init__(self, path: str, most: int = 1 << 18) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.low, self.high = np.zeros(1 << 14, U64), np.zeros(1 << 14, U64)
        self.where = np.full(1 << 14, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1 << 13, np.int64), np.zeros(1 << 13, np.int32)
        self.pool = np.zeros(1 << 14, np.int32)
        self.n, self.used = 0, 0

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each short piece; -1 for one not met."""
        mask = U64(len(self.where) - 1)
        out = np.full(len(low), -1, np.int64)
        slot = mix(low ^ mix(high)) & mask
        at = np.arange(len(low))
        while len(at):
            held = self.where[slot]
            hit = (held >= 0) & (self.low[slot] == low[at]) & (self.high[slot] == high[at])
            out[at[hit]] = held[hit]
            on = ~hit & (held >= 0)
            at, slot = at[on], (slot[on] + U64(1)) & mask
        return out

    def _place(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Enter new, distinct short pieces, after room has been made."""
        size = len(self.where)
        while size < 2 * self.n:
            size *= 2
        if size > len(self.where):
            held = np.flatnonzero(self.where >= 0)
            low, high, number = np.append(self.low[held], low), np.append(self.high[held], high), np.append(self.where[held], number)
            self.low, self.high, self.where = np.zeros(size, U64), np.zeros(size, U64), np.full(size, -1, np.int32)
        mask = U64(size - 1)
        at, slot = np.arange(len(low)), mix(low ^ mix(high)) & mask
        while len(at):  # of those that want one free slot the last gets it
            free = self.where[slot] < 0
            self.where[slot[free]] = number[at[free]]
            won = free & (self.where[slot] == number[at])
            self.low[slot[won]], self.high[slot[won]] = low[at[won]], high[at[won]]
            at, slot = at[~won], (slot[~won] + U64(1)) & mask

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the new pieces data[begin:end], their ids taken in."""
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        white = _BLANK[last] | ((before == 0xC2) & ((last == 0x85) | (last == 0xA0)))
        new = np.zeros(len(begins), np.int32)
        for some in (np.flatnonzero(~white), *np.flatnonzero(white)[:, None]):
            if len(some):
                new[some] = self._take(*self._lines(data, begins[some], ends[some]))
        return new

    def _lines(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has; white space comes as one piece alone."""
        size = ends - begins + 1
        offset = np.cumsum(size) - size
        lines = data[np.minimum(np.repeat(begins - offset, size) + np.arange(int(size.sum())), len(data) - 1)]
        lines[offset + size - 1] = 10
        cuts = [*offset[::_TOGETHER].tolist(), len(lines)]
        found = self.tokenizer.encode_batch_fast([lines[x : y - 1].tobytes().decode() for x, y in zip(cuts, cuts[1:])], add_special_tokens=False)
        if len(begins) == 1:
            return np.array(found[0].ids, np.int32), np.array([len(found[0])], np.int32)
        ids = np.concatenate([np.array([*e.ids, self.newline], np.int32) for e in found])
        cut = ids == self.newline
        sizes = np.diff(np.flatnonzero(np.append(True, cut))) - 1
        if len(sizes) != len(begins):
            raise ValueError("this tokenizer doesn't keep lines apart")
        return ids[~cut], sizes.astype(np.int32)

    def _take(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while len(self.pool) < self.used + len(ids):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        while len(self.sizes) < self.n + len(sizes):
            self.starts, self.sizes = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.sizes, np.zeros_like(self.sizes))
        new = np.arange(self.n, self.n + len(sizes), dtype=np.int32)
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[new] = sizes
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.n += len(sizes)
        self.used += len(ids)
        return new

    def _numbers(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each piece data[begin:end]."""
        size = ends - begins
        found = np.full(len(size), -1, np.int64)
        short = np.flatnonzero(size <= _SHORT)
        at, n = begins[short], size[short]
        loads = eights(data)
        low = loads[at] & _BYTES[np.minimum(n, 8)]
        high = (loads[np.minimum(at + 8, len(data))] & _BYTES[np.maximum(n - 8, 0)]) | n.astype(U64) << U64(56)
        found[short] = self._find(low, high)
        new = np.flatnonzero(found[short] < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[first]
            self._place(low[one], high[one], self._learn(data, at[one], at[one] + n[one]))
            found[short[new]] = self._find(low[new], high[new])
        long = np.flatnonzero(size > _SHORT)
        pieces = [data[x:y].tobytes() for x, y in zip(begins[long].tolist(), ends[long].tolist())]
        met = {p: i for i, p in zip(long.tolist(), pieces) if p not in self.long}
        if met:
            where = np.array(list(met.values()), np.int64)
            self.long.update(zip(met, self._learn(data, begins[where], ends[where]).tolist()))
        found[long] = [self.long[p] for p in pieces]
        return found

    def _cut(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' numbers and rows, and the rows that the library is to encode."""
        rows = len(run)
        points = np.frombuffer(run.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((run.data & 0xC0) != 0x80)
        first = np.searchsorted(places, run.offsets)
        kind = _classes()[np.minimum(points, 0x20FF)]
        n = len(points)
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))
        whole = np.zeros(rows, bool)
        whole[row[kind == _RARE]] = True
        if self.added:
            for m in self.added.finditer(run.data):
                whole[np.searchsorted(run.offsets, m.start(), "right") - 1] = True

        edge = np.zeros(n + 1, bool)
        edge[first] = True  # rows' own ends
        change = edge.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        # white space before a word: all but its last character are one piece, and a last blank joins the word
        cut = change[:n].copy()
        last = (kind == _SPACE) & change[1:] & ~edge[1:]
        cut |= last
        at = np.flatnonzero(last & (points == 32)) + 1
        cut[at] = False
        # contractions: an apostrophe alone that begins a piece takes one or two letters along
        quote = np.flatnonzero((points == 0x27) & cut)
        quote = quote[(quote + 1 < n) & ~edge[quote + 1]]
        one, more = points[quote + 1], quote + 2
        inside = (more < n) & ~edge[np.minimum(more, n)]
        two = np.where(inside, points[np.minimum(more, n - 1)], 0)
        single = np.isin(one, _SINGLE)
        double = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        taken = np.where(single, 1, np.where(double, 2, 0))
        quote, taken = quote[taken > 0], taken[taken > 0]
        cut[quote + 1] = False
        then = quote + 1 + taken
        cut[then[then < n]] |= kind[then[then < n]] == _LETTER
        begins = np.flatnonzero(cut)
        owner = row[begins]
        plain = ~whole[owner]
        ends = np.append(begins[1:], n)
        begins, ends, owner = begins[plain], ends[plain], owner[plain]
        byte = np.append(places, len(run.data))
        return self._numbers(run.data, byte[begins], byte[ends]), owner, np.flatnonzero(whole)

    def encode(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run, one after the other, and how many each has."""
        rows = len(run)
        if self.n > self.most:
            self._clear()
        if not len(run.data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        found, owner, odd_rows = self._cut(run)
        size = self.sizes[found].astype(np.int64)
        counts = np.bincount(owner, size, rows).astype(np.int64)
        offset = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.starts[found] - offset, size) + np.arange(int(size.sum()))]
        if not len(odd_rows):
            return ids, counts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        parts, done = [], 0
        for r, e in zip(odd_rows.tolist(), self._by_library(run, odd_rows)):
            parts += [ids[done : bounds[r]], np.asarray(e.ids, np.int32)]
            done = bounds[r]
            counts[r] = len(e.ids)
        return np.concatenate([*parts, ids[done:]]), counts

    def count(self, run: Run) -> np.ndarray:
        """How many ids each text of a run has."""
        rows = len(run)
        if self.n > self.most:
            self._clear()
        if not len(run.data):
            return np.zeros(rows, np.int64)
        found, owner, odd_rows = self._cut(run)
        counts = np.bincount(owner, self.sizes[found], rows).astype(np.int64)
        for r, e in zip(odd_rows.tolist(), self._by_library(run, odd_rows)):
            counts[r] = len(e.ids)
        return counts

    def _by_library(self, run: Run, rows: np.ndarray) -> list:
        return self.tokenizer.encode_batch([run.text(i) for i in rows.tolist()], add_special_tokens=False) if len(rows) else []


@lru_cache(1)
def kept_encoder(path: str) -> PieceEncoder:
    """An encoder that stays with the worker, for tasks that do little else than encode: what one learns serves the next."""
    return PieceEncoder(path, 1 << 21)


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)
