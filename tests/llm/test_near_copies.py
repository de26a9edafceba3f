"""The pipeline's near-duplicate stage against brute force over sets of five-word shingles."""

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import simhash_wide


def shingles(text):
    w = text.lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def similarity(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y)


def pairs_of(spark, pairs):
    """For each pair of texts, whether the stage joins it; words of different pairs differ."""
    rows = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    got = {r["doc_id"]: r["group_id"] for r in simhash_wide.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


@pytest.mark.parametrize("edit", ["appended", "truncated", "scattered"])
def test_every_pair_from_080_is_found(spark, edit):
    rng = np.random.default_rng(17)
    pairs = []
    for i in range(150):
        base = [f"p{i}w{x}" for x in rng.integers(0, 3000, 400)]
        if edit == "scattered":
            other = list(base)
            for at in rng.choice(400, int(rng.integers(3, 12)), replace=False):
                other[at] = "changed"
        else:
            other = base + [f"p{i}n{x}" for x in range(int(rng.integers(40, 106)))]
        pairs.append((" ".join(base), " ".join(other)) if edit != "truncated" else (" ".join(other), " ".join(base)))
    want = [similarity(x, y) >= 0.8 for x, y in pairs]
    assert 30 < sum(want) < 150
    assert pairs_of(spark, pairs) == want


def test_no_pair_under_080_is_joined(spark):
    """Repeated passages and short texts: a similarity of 0.33 and of 0.71 to 0.78."""
    rng = np.random.default_rng(19)
    pairs = []
    for i in range(60):
        make = lambda n: [f"p{i}w{x}" for x in rng.integers(0, 10**6, n)]  # noqa: E731, B023
        passage = make(60)
        pairs.append((" ".join(passage * 10 + make(60)), " ".join(passage * 10 + make(60))))
        for n in (10, 11, 12, 13):
            short = make(n)
            pairs.append((" ".join(short), " ".join([*short[:-1], "last"])))
    want = [similarity(x, y) >= 0.8 for x, y in pairs]
    assert sum(want) == 60  # those of 13 words: 8 of 10 shingles
    assert pairs_of(spark, pairs) == want


def test_groups_of_a_common_passage_are_brute_forces(spark, monkeypatch):
    """Common shingles, exact copies and a dense group of near copies, in blocks of several chunks."""
    monkeypatch.setattr(simhash_wide, "CHUNK", 16)
    rng = np.random.default_rng(23)
    passage = [f"c{x}" for x in range(30)]
    base = [f"b{x}" for x in range(60)]
    texts = [" ".join(passage + [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(1, 12)))]) for _ in range(120)]
    for _ in range(80):
        w = list(base)
        for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
            w[at] = f"v{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += texts[:5]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = simhash_wide.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["group_id"] for r in got.collect()} == {i: find(i) for i in range(len(texts))}


def test_long_texts_and_their_short_parts(spark):
    """Sets of different sketch lengths, and long ones just over and under the similarity."""
    rng = np.random.default_rng(29)
    pairs = []
    for i in range(12):
        base = [f"p{i}w{x}" for x in rng.integers(0, 10**6, int(rng.integers(300, 4000)))]
        pairs.append((" ".join(base), " ".join(base[: int(len(base) * rng.uniform(0.74, 0.86))])))
    want = [similarity(x, y) >= 0.8 for x, y in pairs]
    assert 2 < sum(want) < 11
    assert pairs_of(spark, pairs) == want


def test_no_pairs_of_a_dense_group_travel_as_rows(spark, monkeypatch):
    """Many texts that are as similar to each other as to the rest: what tiles give is bounded by the sets they hold."""
    rng = np.random.default_rng(31)
    base = [f"b{x}" for x in range(100)]
    texts = []
    for _ in range(300):
        w = list(base)
        for at in rng.choice(100, 2, replace=False):
            w[at] = f"v{rng.integers(0, 999)}"
        texts.append(" ".join(w))
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = {}
    put = simhash_wide.stored

    def stored(df, name):
        out = put(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    made, tiled = [], simhash_wide._tiled
    share = lambda batches, similarity: (made.append(b.num_rows) or b for b in tiled(batches, similarity))
    monkeypatch.setattr(simhash_wide, "stored", stored)
    got = simhash_wide.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["group_id"] for r in got.collect()} == {i: find(i) for i in range(len(texts))}
    assert rows["wide-pairs"] <= 8 * len(texts) and rows.get("wide-bridges", 0) < len(texts)
    # one tile of all sets, none of them tied yet
    value, row = simhash_wide._sets(next(simhash_wide.runs(iter([pa.record_batch({"text": texts})]))))
    size = np.bincount(row)
    bits, many = simhash_wide._parities(value, row, size)
    n, one = len(texts), np.zeros(len(texts), np.int64)
    tile = pa.RecordBatch.from_arrays([pa.array(x) for x in (one, one, one, one, np.arange(n), np.arange(n), size)] + [simhash_wide._lists(bits, many)], ["key", "one", "two", "chunk", "node", "label", "size", "bits"])
    list(share(iter([tile]), 0.8))
    assert 0 < sum(made) < n
