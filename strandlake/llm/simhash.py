"""Operator 4: SimHash near-duplicates through pigeonhole blocks.

A text is lower-cased (A-Z) and split at white space; every shingle of
consecutive words, repeats included, votes with the bits of its XXH64. Close
fingerprints agree on whole blocks of bits, so they are joined on combinations
of blocks and the Hamming distance is verified afterwards.

Defined results: null and empty texts have fingerprint zero and link like any
other; a text of any length is read whole; further columns are left out; repeated rows come back as often as they stand in the input; a null
doc_id keeps its row and takes no part in naming a component (a component of
such rows alone is named null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import dropped, mapped, stored, table
from strandlake.llm.components import components
from strandlake.llm.words import LOWER, runs

SEED = 42
_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    votes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for i in range(0, len(votes), 4096):  # bounds the unpacked bits of a long text
        total += np.unpackbits(votes[i : i + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(votes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for run in runs(batches):
        found = [fingerprint(run.raw(i), shingle) for i in range(len(run))]
        yield pa.RecordBatch.from_arrays([run.batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    return mapped(documents.select(F.col("doc_id").cast("long"), "text"), partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of which two fingerprints within ``distance`` share one at least.

    ``distance`` differing bits touch that many of the ``blocks`` at most, so the
    fingerprints agree on some ``blocks - distance`` of them.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    joined = [sum(x) for x in combinations(part, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in joined]


def _index(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    keys = [F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("m")) for i, m in enumerate(masks(distance, blocks))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.c", "k.m")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the labels of all pairs (one of a, one of b) within the distance; as few as join them."""
    root = {int(x): int(x) for x in np.concatenate([la, lb])}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    edges = []
    for i in range(0, len(a), 256):
        near = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= distance
        near &= la[i : i + 256, None] != lb[None, :]
        x, y = np.nonzero(near)
        if not len(x):
            continue
        for p, q in np.unique(np.stack([la[i : i + 256][x], lb[y]], 1), axis=0):
            rp, rq = find(int(p)), find(int(q))
            if rp != rq:
                root[max(rp, rq)] = min(rp, rq)
                edges.append((int(p), int(q)))
        la = np.array([find(int(v)) for v in la], np.int64) if len(edges) else la
        lb = np.array([find(int(v)) for v in lb], np.int64) if len(edges) else lb
    return edges


def _tiles(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile holds two chunks of a block's fingerprints at most."""
    out: list[tuple[int, int]] = []

    def work(rows: list[np.ndarray]) -> None:
        fp, label, chunk, one, two = (np.concatenate([r[i] for r in rows]) for i in range(5))
        p, q = chunk == one[0], chunk == two[0]
        u = fp.view(np.uint64)
        out.extend(_forest(u[p], label[p], u[q], label[q], distance))

    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c, m, one, two, fp, label, chunk = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7))
        change = np.flatnonzero((np.diff(c) != 0) | (np.diff(m) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
        cuts = [0, *change.tolist(), len(c)]
        for s, e in zip(cuts, cuts[1:]):
            key = (c[s], m[s], one[s], two[s])
            if last is not None and key != last:
                work(held)
                held = []
            last = key
            held.append([x[s:e] for x in (fp, label, chunk, one, two)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
            out.clear()
    if held:
        work(held)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def hot_blocks(fps: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Stored rows (c, m, fp, n, pivot) of the distinct fingerprints ``fps`` (fp), for the blocks that several share.

    A block's size and least fingerprint (its pivot) are added up before they are shuffled.
    """
    index = _index(fps, distance, blocks)
    shared = stored(index.groupBy("c", "m").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).filter("n > 1"), "blocks")
    hot = stored(index.join(shared, ["c", "m"]), "hot")
    dropped(shared)
    return hot


def pivot_links(hot: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): the fingerprints within the distance of a pivot of theirs, and that pivot."""
    return hot.filter((F.col("fp") != F.col("pivot")) & (differing(F.col("fp"), F.col("pivot")) <= distance)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))


def linked(fps: DataFrame, distance: int = 3, blocks: int = 6, chunk: int = 2048) -> DataFrame:
    """(node, label): components of the distinct fingerprints ``fps`` (fp), for those that have a link.

    Blocks shared by one fingerprint only end early. In the others, each
    fingerprint is first compared with the least one of its block; the
    components of those links settle most of a dense group. Only blocks that
    still hold several components are compared in full, in tiles of two chunks
    of about ``chunk`` fingerprints, and a tile gives a spanning forest instead
    of all its pairs. So a block of any size is spread over tasks of bounded
    memory, no link is lost, and no pair list grows with the square of a group.
    """
    blocked = hot_blocks(fps, distance, blocks)
    found = stored(components(pivot_links(blocked, distance)), "pivots")
    hot = blocked.join(found, blocked["fp"] == found["node"], "left").select("c", "m", "fp", "n", F.coalesce("label", "fp").alias("label"))
    hot = stored(hot, "labelled")
    dropped(blocked)
    mixed = hot.groupBy("c", "m").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("c", "m")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    tiles = (
        hot.join(mixed, ["c", "m"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("c", "m", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "fp", "label", "chunk")
    )
    sort = ["c", "m", "one", "two"]
    edges = mapped(tiles.repartition(*sort).sortWithinPartitions(*sort), partial(_tiles, distance=distance), "a long, b long")
    more = stored(components(edges), "merged")
    dropped(hot)
    merged = found.join(more.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    merged = merged.select("node", F.coalesce("least", "label").alias("label"))
    alone = more.join(found, "node", "left_anti").select("node", "label")
    return merged.unionByName(alone)


def components_of(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    link = linked(distinct.select("fp"), distance, blocks)
    named = distinct.join(link, distinct["fp"] == link["node"]).select("fp", "rep", "label")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    named = stored(named.join(least, "label").select(F.col("fp").alias("node"), "least"), "named")
    distinct = distinct.join(named, distinct["fp"] == named["node"], "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(distinct, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id as the smallest doc_id reachable)."""
    prints = stored(fingerprints(documents, shingle), "fingerprints")
    out = components_of(prints, distance, blocks)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
