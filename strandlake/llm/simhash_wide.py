"""Near-duplicates by similarity: all pairs of texts that share 80 % of their distinct five-word shingles.

A text is the set of its distinct five-word shingles (lower-cased words between
white space; a text of fewer words is one shingle). Candidates come from two
joins, and each pair that counts is verified by the Jaccard similarity of the
two sets:

* SimHash fingerprints of the sets, joined on operator 4's pigeonhole blocks.
  They find most near copies, but a fingerprint of fixed length can't show every
  pair of that similarity.
* So an exact join stands beside it. In any order of all shingles, two sets of
  similarity t or more share one of the first ``n - ceil(t * n) + 1`` shingles of
  each: those are a text's keys. The order puts the shingles that many texts of
  a sample hold last, the most common at the very end, so that common passages
  make few and small blocks; it bears on speed only.

Candidates that cannot reach the similarity are dropped without a loss before:
by their sizes, and by the parity of the shingles in each of many classes, since
two sets differ in no more parities than shingles. A set has some 1.5 to 3
classes for each shingle, a power of two, so that the parities of the larger of
two fold into those of the smaller. Sets are never stored:
the texts that take part in a pair are read again, and each set travels to the
tiles of its family, the sets that candidate pairs tie together.

Shingles are told apart by 64-bit hashes. Defined results: null and empty texts
are copies of each other; rows are told apart by id and text; a text of any
length is read whole; an empty table gives an empty result; further columns pass
through, whatever their names. Groups are the connected components of the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import BROADCAST_ROWS, carried, dropped, mapped, stored, text_hash
from strandlake.llm.components import components
from strandlake.llm.simhash import hot_blocks, pivot_links
from strandlake.llm.words import LOWER, NON_SPACE, Run, grams, runs, same_row, span_hash, split

SIMILARITY = 0.8
SHINGLE = 5
#: Classes of parities of a set, at least, and for each shingle.
BITS, BITS_EACH = 512, 1.5
CHUNK = 2048
#: Texts whose shingles are counted for the order, the count from which a shingle is common, and common ones at most.
SAMPLE, COMMON, MOST_COMMON = 8_000, 3, 100_000
#: Rows handled in one numpy pass, and texts that a task remembers as seen.
ROWS, SEEN = 1024, 50_000
#: Bytes of the sets that a chunk of a family holds, about; a tile is two chunks.
CHUNK_BYTES = 8 << 20
#: Texts that are looked for by a broadcast (some 100 bytes each); more are found by a shuffled join.
BROADCAST_TEXTS = 300_000

_EDGE = 1e-9
_RECORD = "doc_id long, row_hash long, node long, size long, fp long, bits array<long>, keys array<long>"
_TILES = "array<struct<family:long,one:int,two:int>>"


def _lists(values: np.ndarray, counts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of ``counts`` 64-bit values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), mask=None if valid is None else pa.array(~valid))


def _sets(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows of a run, ascending in each row, and their rows."""
    data = LOWER[run.data]
    words = split(run, NON_SPACE, data)
    hashes = span_hash(data, words.starts, words.ends)
    at = np.flatnonzero(same_row(words, SHINGLE))
    row, value = [words.row[at]], [grams(hashes, SHINGLE)[at]]
    for m in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == m)
        if len(short):
            row.append(short)
            value.append(grams(hashes, m, salt=m)[words.first[:-1][short]])
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], row[new]


def _parities(value: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parities of each row's shingles in its classes, 64 to a number, and how many numbers each row has."""
    classes = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(BITS_EACH * size, 1))).astype(np.int64))
    first = np.cumsum(classes) - classes
    place = first[row] + (value & (classes[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(classes.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64), classes // 64


@dataclass
class Sketches:
    """Parities of many sets, one after another."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Sketches:
        length = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
        words = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        return cls(words, np.cumsum(length) - length, length)

    def rows(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words[self.start[s] : self.start[e - 1] + self.length[e - 1]], self.length[s:e]

    def folded(self, at: np.ndarray, to: int) -> np.ndarray:
        """(len(at), to): the parities of the sets ``at``, folded to ``to`` numbers."""
        out = np.empty((len(at), to), np.uint64)
        for n in np.unique(self.length[at]).tolist():
            own = np.flatnonzero(self.length[at] == n)
            words = self.words[self.start[at[own]][:, None] + np.arange(n)]
            while words.shape[1] > to:
                half = words.shape[1] // 2
                words = words[:, :half] ^ words[:, half:]
            out[own] = words
        return out


def _near(a: Sketches, p: np.ndarray, b: Sketches, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the parities of a[p] and b[q] differ in ``most`` places at most, for each of the pairs."""
    out = np.zeros(len(p), bool)
    least = np.minimum(a.length[p], b.length[q])
    for n in np.unique(least).tolist():
        own = np.flatnonzero(least == n)
        step = max(1, (1 << 20) // int(max(a.length[p[own]].max(), b.length[q[own]].max())))
        for s in range(0, len(own), step):
            at = own[s : s + step]
            out[at] = np.bitwise_count(a.folded(p[at], n) ^ b.folded(q[at], n)).sum(1, dtype=np.int64) <= most[at]
    return out


def _fingerprints(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each row's set: the majority of its shingles' bits, as signed numbers."""
    votes = np.zeros((n, 64), np.int64)
    for s in range(0, len(value), 1 << 16):
        own = row[s : s + (1 << 16)]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(value[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        votes[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > np.bincount(row, minlength=n)[:, None], axis=1).view(np.int64).ravel()


def prefix(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's first shingles must hold one of every set as similar as that."""
    return np.minimum(size, size - np.ceil(similarity * size - _EDGE).astype(np.int64) + 1)


def _recorded(batches: Iterator[pa.RecordBatch], common: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Records of rows (doc_id, row_hash, text); a text's keys stand with its first row in the task alone."""
    order = np.argsort(common)
    held = common[order]
    seen: set[int] = set()
    for run in runs(batches):
        value, row = _sets(run)
        n = len(run)
        size = np.bincount(row, minlength=n)
        first = np.cumsum(size) - size
        node = span_hash(value.view(np.uint8), 8 * first, 8 * (first + size)).view(np.int64)
        (bits, many_bits), fp = _parities(value, row, size), _fingerprints(value, row, n)
        if len(held):
            place = np.minimum(np.searchsorted(held, value), len(held) - 1)
            rank = np.where(held[place] == value, order[place] + 1, 0)
            value = value[np.lexsort((rank, row))]  # equal ranks keep the order of their hashes
        new = np.zeros(n, bool)
        for i, v in enumerate(node.tolist()):
            if v not in seen:
                seen.add(v)
                new[i] = True
        if len(seen) > SEEN:
            seen.clear()
        many = np.where(new, prefix(size, similarity), 0)
        taken = np.arange(len(value)) - first[row] < many[row]
        yield pa.RecordBatch.from_arrays(
            [*run.batch.columns[:2], pa.array(node), pa.array(size), pa.array(fp), _lists(bits, many_bits), _lists(value[taken], many, new)],
            ["doc_id", "row_hash", "node", "size", "fp", "bits", "keys"],
        )


def _identified(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), F.col("text").cast("string"))


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_sets(run)[0].view(np.int64))], ["value"])


def common_shingles(documents: DataFrame) -> np.ndarray:
    """The shingles that many texts of a sample hold, the rarer ones first; at most ``MOST_COMMON``."""
    texts = documents.select(F.col("text").cast("string"))
    share = max(1, texts.count() // SAMPLE)
    drawn = texts.filter(F.pmod(text_hash(), F.lit(share)) == 0).dropDuplicates(["text"])
    counted = mapped(drawn, _singles, "value long").groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    held = counted.orderBy(F.desc("n"), "value").limit(MOST_COMMON).collect()
    return np.array([r["value"] for r in reversed(held)], np.int64).view(np.uint64)


def records(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A record of every row: a hash that names its set, the set's size, fingerprint and parities, and its keys."""
    return mapped(_identified(documents), partial(_recorded, common=common_shingles(documents), similarity=similarity), _RECORD)


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that reach the similarity, of rows (family, one, two, b, a, grams) that come tile by tile, first its
    sets (b is null), then its pairs."""
    now, sets = None, {}
    for batch in batches:
        found: list[tuple[int, int]] = []
        grams_of = batch.column(5)
        for i, (family, one, two, b, a) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)))):
            if now != (family, one, two):
                now, sets = (family, one, two), {}
            if b is None:
                if a not in sets:
                    sets[a] = np.frombuffer(grams_of[i].as_buffer(), np.uint64).copy()
                continue
            x, y = sets[a], sets[b]
            both = len(x) + len(y) - len(np.union1d(x, y))
            if both >= similarity * (len(x) + len(y) - both) - _EDGE:
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])


def _addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text (node, tiles, text), once for each of its tiles; repeats of a text within the task are left out."""
    seen: set[int] = set()
    for run in runs(batches):
        value, row = _sets(run)
        cut = np.searchsorted(row, np.arange(len(run) + 1)).tolist()
        out: list[tuple] = []
        for i, (node, tiles) in enumerate(zip(run.batch.column(0).to_pylist(), run.batch.column(1).to_pylist())):
            if node in seen:
                continue
            seen.add(node)
            own = value[cut[i] : cut[i + 1]].tobytes()
            for t in tiles:
                out.append((t["family"], t["one"], t["two"], node, own))
                if len(out) == ROWS:
                    yield _rows(out)
                    out = []
        if len(seen) > SEEN:
            seen.clear()
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["family", "one", "two", "a", "grams"])


def chunks(family: DataFrame, info: DataFrame) -> DataFrame:
    """(node, family, chunk, parts) of (node, label): families of many or large sets are cut into parts."""
    sized = family.join(info.select("node", "size"), "node")
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(8 * F.sum("size") / CHUNK_BYTES), F.lit(1)).cast("int")
    counts = sized.groupBy("label").agg(parts.alias("parts"))
    return family.join(counts, "label").select("node", F.col("label").alias("family"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("chunk"), "parts")


def verified(pairs: DataFrame, info: DataFrame, nodes: DataFrame, documents: DataFrame, similarity: float) -> DataFrame:
    """The stored pairs (a, b) whose sets reach the Jaccard similarity; ``nodes`` (node, rep) says where their texts stand.

    Pairs are dealt out by the family (component of the candidate pairs) that
    they are in; a family of many or large sets is cut into chunks and its pairs
    into tiles of two chunks, so that a task holds few sets, a set travels to the
    tiles that have a pair of it and no further, and no family is one task's work.
    """
    family = stored(components(pairs), "wide-families")
    placed = chunks(family, info).drop("parts")
    placed = stored(placed, "wide-chunks")
    of = lambda end: placed.select(F.col("node").alias(end), "family", F.col("chunk").alias(f"{end}_chunk"))
    tiled = pairs.join(of("a"), "a").join(of("b").drop("family"), "b")
    tiled = stored(tiled.select("family", F.least("a_chunk", "b_chunk").alias("one"), F.greatest("a_chunk", "b_chunk").alias("two"), "a", "b"), "wide-tiles")
    wanted = tiled.select(F.explode(F.array("a", "b")).alias("node"), F.struct("family", "one", "two").alias("tile")).groupBy("node").agg(F.collect_set("tile").alias("tiles"))
    wanted = stored(wanted.join(nodes, "node").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.row_hash").alias("hash"), F.col("tiles").cast(_TILES)), "wide-wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted.hint("merge")
    rows = _identified(documents)
    texts = rows.join(side, rows["doc_id"].eqNullSafe(side["id"]) & (rows["row_hash"] == side["hash"])).select("node", "tiles", "text")
    sets = mapped(texts, _addressed, "family long, one int, two int, a long, grams binary")
    tile = ["family", "one", "two"]
    both = sets.select(*tile, F.lit(None).cast("long").alias("b"), "a", "grams").unionByName(tiled.select(*tile, "b", "a", F.lit(None).cast("binary").alias("grams")))
    both = both.repartition(*tile).sortWithinPartitions(*tile, F.asc_nulls_first("b"))
    found = stored(mapped(both, partial(_compared, similarity=similarity), "a long, b long"), "wide-verified")
    dropped(family, placed, tiled, wanted)
    return found


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, total, a_bits, b_bits) that the parities leave possible; total is the sum of both sizes."""
    share = (1 - similarity) / (1 + similarity)
    for batch in batches:
        every = np.arange(batch.num_rows)
        total = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
        near = pa.array(_near(Sketches.of(batch.column(3)), every, Sketches.of(batch.column(4)), every, share * total + _EDGE))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in range(2)], ["a", "b"])


def _possible(pairs: DataFrame, info: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) that sizes and parities leave possible."""
    own = lambda end: info.select(F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col("bits").alias(f"{end}_bits"))
    both = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(own("a"), "a").join(own("b"), "b")
    both = both.filter(F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - _EDGE)
    return mapped(both.select("a", "b", (F.col("a_size") + F.col("b_size")).alias("total"), "a_bits", "b_bits"), partial(_alike, similarity=similarity), "a long, b long")


@dataclass
class Chunk:
    """Sets of a tile."""

    node: np.ndarray
    label: np.ndarray
    size: np.ndarray
    bits: Sketches

    def part(self, own: np.ndarray) -> Chunk:
        at = np.flatnonzero(own)
        return Chunk(self.node[at], self.label[at], self.size[at], Sketches(self.bits.words, self.bits.start[at], self.bits.length[at]))


class Forest:
    """Groups of nodes: ``of`` has a number for each place, equal where places are tied."""

    def __init__(self, node: np.ndarray, tied: np.ndarray) -> None:
        """``tied`` has the same number for places that belong together from the beginning."""
        self.node, self.of = node, np.unique(tied, return_inverse=True)[1]

    def tie(self, a: int, b: int) -> tuple[int, int]:
        """Put the groups of two places together; the nodes of the two."""
        self.of[self.of == self.of[b]] = self.of[a]
        return int(self.node[a]), int(self.node[b])


def _tree(a: Chunk, b: Chunk, forest: Forest, at: tuple[np.ndarray, np.ndarray], similarity: float, checked: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of nodes (one of a, one of b) of different labels that tie groups of the forest together; ``at`` are the places of
    both chunks in it. Sizes and parities leave each pair possible, and ``checked`` says of two places whether it holds.

    All pairs are looked at, but for those that are tied by then."""
    share = (1 - similarity) / (1 + similarity)
    for i in range(0, len(a.node), 128):
        size, label, tied = a.size[i : i + 128, None], a.label[i : i + 128, None], forest.of[at[0][i : i + 128], None]
        open_ = (tied != forest.of[at[1]]) & (label != b.label) & (np.minimum(size, b.size) >= similarity * np.maximum(size, b.size) - _EDGE)
        rows, columns = np.nonzero(open_)
        rows += i
        for s in range(0, len(rows), 1 << 14):
            p, q = rows[s : s + (1 << 14)], columns[s : s + (1 << 14)]
            some = forest.of[at[0][p]] != forest.of[at[1][q]]
            p, q = p[some], q[some]
            near = _near(a.bits, p, b.bits, q, share * (a.size[p] + b.size[q]) + _EDGE)
            p, q = at[0][p[near]], at[1][q[near]]
            j = 0
            while j < len(p):
                x, y = int(p[j]), int(q[j])
                j += 1
                if checked is None or checked(x, y):
                    yield forest.tie(x, y)
                    some = forest.of[p[j:]] != forest.of[q[j:]]
                    p, q, j = p[j:][some], q[j:][some], 0


def _tiled(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (key, one, two, chunk, node, label, size, bits) sorted by tile, two chunks of one block at most: as few pairs
    (a, b) as tie together all nodes of a tile that its possible pairs tie together. So there are fewer pairs than nodes."""
    held: list[tuple[np.ndarray, ...]] = []
    last = None

    def work() -> Iterator[pa.RecordBatch]:
        one, two, chunk, node, label, size, words, length = (np.concatenate(x) for x in zip(*held))
        whole = Chunk(node, label, size, Sketches(words, np.cumsum(length) - length, length))
        at = np.flatnonzero(chunk == one[0]), np.flatnonzero(chunk == two[0])
        found = list(_tree(whole.part(chunk == one[0]), whole.part(chunk == two[0]), Forest(node, node), at, similarity))
        yield _pairs(found)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, one, two, chunk, node, label, size = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(7))
        bits = Sketches.of(batch.column(7))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = (key[s], one[s], two[s])
            if last is not None and now != last:
                yield from work()
                held = []
            last = now
            held.append((one[s:e], two[s:e], chunk[s:e], node[s:e], label[s:e], size[s:e], *bits.rows(s, e)))
    if held:
        yield from work()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (max, min)], ["a", "b"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text (node, family, chunk, parts, label, text), once for each tile of its chunk; repeats of a text within the task are left out."""
    seen: set[int] = set()
    for run in runs(batches):
        value, row = _sets(run)
        cut = np.searchsorted(row, np.arange(len(run) + 1)).tolist()
        out: list[tuple] = []
        for i, (node, family, chunk, parts, label) in enumerate(zip(*(run.batch.column(j).to_pylist() for j in range(5)))):
            if node in seen:
                continue
            seen.add(node)
            own = value[cut[i] : cut[i + 1]].tobytes()
            for other in range(parts):
                out.append((family, min(chunk, other), max(chunk, other), chunk, node, label, own))
                if len(out) == ROWS:
                    yield _set_rows(out)
                    out = []
        if len(seen) > SEEN:
            seen.clear()
        yield _set_rows(out)


_SET_ROW = "family long, one int, two int, chunk int, node long, label long, grams binary"


def _set_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in _SET_ROW.split(", ")])


def _bridged(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (family, one, two, chunk, node, label, grams) sorted by tile: as few pairs (a, b) whose sets reach the similarity
    as tie together all labels of a tile that such pairs tie together."""
    now, held = None, {}

    def work() -> Iterator[pa.RecordBatch]:
        node = np.array(list(held), np.int64)
        chunk, label = (np.array([x[i] for x in held.values()], np.int64) for i in range(2))
        sets = [x[2] for x in held.values()]
        size = np.array([len(x) for x in sets], np.int64)
        bits, many = _parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size)
        whole = Chunk(node, label, size, Sketches(bits, np.cumsum(many) - many, many))

        def checked(x: int, y: int) -> bool:
            total = len(sets[x]) + len(sets[y])
            both = total - len(np.union1d(sets[x], sets[y]))
            return both >= similarity * (total - both) - _EDGE

        at = np.flatnonzero(chunk == now[1]), np.flatnonzero(chunk == now[2])
        yield _pairs(list(_tree(whole.part(chunk == now[1]), whole.part(chunk == now[2]), Forest(node, label), at, similarity, checked)))

    for batch in batches:
        grams_of = batch.column(6)
        for i, (family, one, two, chunk, node, label) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(6)))):
            if now != (family, one, two):
                if held:
                    yield from work()
                now, held = (family, one, two), {}
            if node not in held:
                held[node] = (chunk, label, np.frombuffer(grams_of[i].as_buffer(), np.uint64).copy())
    if held:
        yield from work()


def bridged(ties: DataFrame, label: DataFrame, info: DataFrame, nodes: DataFrame, documents: DataFrame, similarity: float) -> DataFrame:
    """Stored pairs (a, b) whose sets reach the similarity: they tie together all labels that such pairs of the families tie together.

    A family is a component of the pairs ``ties``. It is cut into chunks, and each set travels to the tiles of its own chunk, as
    many as the family has chunks. In a tile all pairs of different labels are looked at that aren't tied by pairs found before,
    so no pair travels as a row, and a tile gives fewer pairs than it has labels.
    """
    family = stored(components(ties), "wide-families")
    placed = chunks(family, info).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    wanted = placed.join(nodes, "node").select("node", "family", "chunk", "parts", "label", F.col("rep.doc_id").alias("id"), F.col("rep.row_hash").alias("hash"))
    wanted = stored(wanted, "wide-wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted.hint("merge")
    rows = _identified(documents)
    texts = rows.join(side, rows["doc_id"].eqNullSafe(side["id"]) & (rows["row_hash"] == side["hash"])).select("node", "family", "chunk", "parts", "label", "text")
    tile = ["family", "one", "two"]
    sets = mapped(texts, _placed, _SET_ROW).repartition(*tile).sortWithinPartitions(*tile, "node")
    found = stored(mapped(sets, partial(_bridged, similarity=similarity), "a long, b long"), "wide-bridges")
    dropped(family, wanted)
    return found


def shared_keys(rows: DataFrame) -> DataFrame:
    """Stored rows (key, node, n, pivot) of the keys that several sets hold; counts are added up before the shuffle."""
    keys = rows.filter("keys is not null").select("node", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("far"), F.count("*").alias("n")).filter("pivot < far")
    return stored(keys.join(several.select("key", "n", "pivot"), "key"), "wide-shared")


def pigeonhole_pairs(info: DataFrame) -> DataFrame:
    """(a, b): sets of one fingerprint, and fingerprints within three bits of the least one of a pigeonhole block."""
    heads = stored(info.groupBy("fp").agg(F.min("node").alias("head")), "wide-fingerprints")
    same = info.select("node", "fp").join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    hot = hot_blocks(heads.select("fp"))
    some = pivot_links(hot).groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
    of = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = some.join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    pairs = stored(same.unionByName(near), "wide-pigeonholes")
    dropped(heads, hot)
    return pairs


def linked(rows: DataFrame, nodes: DataFrame, documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Stored (node, label) for the sets of the records that have a link: label is the least node of the component.

    Each set is first compared with those that the pigeonhole blocks show, and
    with the least set of up to three of its keys; the components of those links
    settle most of a dense group. Then the keys' blocks that hold several
    components are looked at in full, in tiles of two chunks of about ``CHUNK``
    sets: a tile tells which of its sets possible pairs tie together, by a tree of
    them. In the families that these make, the sets themselves are compared, so every pair of the
    similarity is either inside one component already or looked at.
    """
    info = stored(rows.filter("keys is not null").select("node", "size", "fp", "bits").dropDuplicates(["node"]), "wide-info")
    shared = shared_keys(rows)
    pivots = F.array_distinct(F.array(F.min("pivot"), F.max("pivot"), F.min_by("pivot", "key")))
    some = shared.filter("node <> pivot").groupBy(F.col("node").alias("a")).agg(pivots.alias("b")).select("a", F.explode("b").alias("b"))
    holes = pigeonhole_pairs(info)
    pairs = stored(_possible(some.unionByName(holes), info, similarity), "wide-pairs")
    good = verified(pairs, info, nodes, documents, similarity)
    found = stored(components(good), "wide-found")
    dropped(holes, pairs, good)
    named = stored(shared.join(found, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")), "wide-named")
    dropped(shared)
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    tiles = (
        named.join(mixed, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "node", "label")
        .join(info.select("node", "size", "bits"), "node")
        .select("key", "one", "two", "chunk", "node", "label", "size", "bits")
    )
    sort = ["key", "one", "two"]
    left = stored(mapped(tiles.repartition(*sort).sortWithinPartitions(*sort, "node"), partial(_tiled, similarity=similarity), "a long, b long").distinct(), "wide-left")
    dropped(named)
    good = bridged(left, found, info, nodes, documents, similarity)
    of = lambda end: F.coalesce(F.col(f"{end}_label"), F.col(end)).alias(end)
    label = lambda end: found.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    more = stored(components(good.join(label("a"), "a", "left").join(label("b"), "b", "left").select(of("a"), of("b"))), "wide-merged")
    merged = found.join(more.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    out = stored(merged.unionByName(more.join(found, "node", "left_anti").select("node", "label")), "wide-linked")
    dropped(info, left, good, found, more)
    return out


def grouped(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Stored (doc_id, row_hash, group_id, group_hash): the least (doc_id, row_hash) of each row's group of exact and near copies."""
    rows = stored(records(documents, similarity), "wide-records")
    named = rows.select("doc_id", "row_hash", "node")
    nodes = stored(named.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("rep")), "wide-nodes")
    link = linked(rows, nodes, documents, similarity)
    joined = nodes.join(link, "node")
    least = joined.groupBy("label").agg(F.min("rep").alias("least"))
    moved = stored(joined.join(least, "label").select("node", "least"), "wide-moved")
    reps = nodes.join(moved, "node", "left").select("node", F.coalesce("least", "rep").alias("g"))
    out = stored(named.join(reps, "node").select("doc_id", "row_hash", F.col("g.doc_id").alias("group_id"), F.col("g.row_hash").alias("group_hash")), "wide-groups")
    dropped(rows, nodes, link, moved)
    return out


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with their own columns, of which one stays for each group of exact and near copies: that of the least
    doc_id, nulls first. Rows that repeat it whole go too."""
    groups = grouped(documents, similarity)
    stays = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("row_hash") == F.col("group_hash"))
    odd = groups.groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    odd = stored(odd.filter("not stays or n > 1").select("id", "hash", "stays"), "wide-odd")  # rows that go, and those that stand several times
    dropped(groups)
    side = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd.hint("merge")
    rows = documents.select(carried(documents), F.col("doc_id").cast("long").alias("own_id"), text_hash(F.col("text").cast("string")).alias("own_hash"))
    found = rows.join(side, rows["own_id"].eqNullSafe(side["id"]) & (rows["own_hash"] == side["hash"]), "left")
    once = found.filter("hash is null").select("row.*")
    repeated = found.filter("stays").dropDuplicates(["own_id", "own_hash"]).select("row.*")
    return once.unionByName(repeated)
