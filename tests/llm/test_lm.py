"""Operator 11: the model against plain loops, its training, and the registered query over awkward tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import attention, lm, queries
from strandlake.llm.attention import BLOCK, KEY, Model
from strandlake.llm.tokens import tokenizer_path
from tests.llm.corpus import documents, lower, spaced


@pytest.fixture(scope="module")
def model():
    """A small vocabulary, and parameters with something to tell."""
    counts = np.array([50, 3, 0, 20, 20, 7, 0, 1, 1, 900, 11, 4])
    v = attention.vocabulary(counts, 7, head=8, classes=3)
    flat = attention.started(v)
    flat += np.random.default_rng(1).normal(0, 0.3, flat.shape).astype(np.float32)
    return counts, v, Model(flat.astype(np.float32), v)


def chances(model, v, before, own):
    """Chances of all ids after the last of ``own``, by loops; ``before`` is the block before, with missing ids left out."""
    p = {k: x.astype(float) for k, x in model.p.items()}
    q = p["query"][own[-1]]
    window = [(r, len(own) - 1 - i) for i, r in enumerate(own)] + [(r, len(own) - 1 + BLOCK - i) for i, r in enumerate(before)]
    weight = np.array([math.exp(q @ p["key"][r] / math.sqrt(KEY) + p["near"][d]) for r, d in window])
    met = sum(w * p["value"][r] for w, (r, _) in zip(weight / weight.sum(), window))
    h = np.maximum(p["own"][own[-1]] + p["lift"] + met @ p["mixing"], 0)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    of_class = soft(h @ p["to_class"] + p["class_bias"])
    inner = h @ p["to_id"] + p["id_bias"]
    out = np.zeros(len(v.rank))
    for i, r in enumerate(v.rank):
        c = int(np.searchsorted(v.bounds, r, "right")) - 1
        if r == v.bounds[-1]:
            out[i] = of_class[c] * math.exp(v.log_share[i])
        else:
            own_class = slice(v.bounds[c], v.bounds[c + 1])
            out[i] = of_class[c] * soft(inner[own_class])[r - v.bounds[c]]
    return out


def test_scores_are_those_of_loops_and_chances_sum_to_one(model):
    counts, v, m = model
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, len(counts), n) for n in (0, 1, 7, 8, 9, 40)]
    end = int(v.rank[7])
    ranks = np.concatenate(texts)
    got = attention.score(m, v.rank[ranks].astype(np.int16), np.array([len(t) for t in texts]), end, at_once=2, together=2)
    for text, score in zip(texts, got):
        line = [end, *v.rank[text]]
        want = 0.0
        for i, following in enumerate([*text, 7]):
            start = i - i % BLOCK
            found = chances(m, v, line[max(0, start - BLOCK) : start], line[start : i + 1])
            assert abs(found.sum() - 1) < 1e-6
            want += math.log(found[following])
        assert abs(want - score - v.log_share[text].sum()) < 1e-3


def test_nothing_is_seen_before_its_place(model):
    _, v, m = model
    ranks = np.arange(60, dtype=np.int16) % 9
    own, _, starts = attention.blocks(ranks, np.array([60]), 0, v.pad)
    first = np.zeros(len(own) - 1, bool)
    a = m.hidden(own, first)
    other = own.copy()
    other[3, 4:] = 2
    b = m.hidden(other, first)
    same = (3 - 1) * BLOCK + 4
    assert np.array_equal(a[:same], b[:same]) and not np.allclose(a[same:], b[same:])


def test_gradient_is_that_of_differences(model):
    _, v, m = model
    rng = np.random.default_rng(3)
    windows = rng.integers(0, v.pad + 1, (40, 3, BLOCK)).astype(np.int16)
    windows[:, 1, 0] = 1
    g = attention.named(m.gradient(windows)[0], v)
    for name, x in g.items():
        step = rng.normal(size=x.shape).astype(np.float32)
        loss = []
        for s in (1e-3, -1e-3):
            flat = m.flat.copy()
            attention.named(flat, v)[name][:] += s * step
            loss.append(Model(flat, v).gradient(windows)[1])
        assert abs((loss[0] - loss[1]) / 2e-3 - float((x * step).sum())) < 0.02 + 0.03 * abs(float((x * step).sum())), name


def test_training_learns_what_unigrams_cannot():
    counts = np.full(6, 100)
    v = attention.vocabulary(counts, 5, head=5, classes=3)
    line = np.tile(v.rank[[0, 1, 2, 3]], 500).astype(np.int16)
    end = int(v.rank[5])
    windows = attention.windows(*attention.blocks(line, np.array([2000]), end, v.pad), v.pad)
    before = attention.score(Model(attention.started(v), v), line, np.array([2000]), end)[0]
    after = attention.score(Model(attention.train(attention.started(v), v, windows, 200, 64, 0.02), v), line, np.array([2000]), end)[0]
    assert after > 0.1 * before


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lm")
    rng = np.random.default_rng(4)
    long = " ".join(f"W{x}" for x in rng.integers(0, 3000, 60_000))
    docs = documents(spark, [long, "x" * 5000, "The wind of the lake and the river. " * 20, "<|endoftext|> ſ"]).select("*", F.lit(1).alias("word"), F.lit(2).alias("number"), F.lit(0.5).alias("score"))
    docs.write.parquet(f"{root}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{root}/empty/documents.parquet")
    docs.filter("crc32(cast(doc_id as string)) % 5 = 1").write.parquet(f"{root}/held/documents.parquet")
    return root


def test_query_counts_as_loops_do(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*spaced(lower(t)), None]
    counts = Counter(x for r in docs if not held(r["doc_id"]) for x in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in docs:
        t = tokens(r["text"])
        want.append((str(r["doc_id"]), held(r["doc_id"]), len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    got = queries.queries()["op11_attention"](spark, f"{tables}/full").collect()
    order = lambda x: (x[0], x[2], x[5])
    for a, b in zip(sorted(want, key=order), sorted(((str(r["doc_id"]), *tuple(r)[1:6]) for r in got), key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(a[5]) + 1e-9
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 3 and max(same) - min(same) < 1e-6 * abs(same[0])


def test_ids_are_the_tokenizers(spark, tables):
    own = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{tables}/full/documents.parquet").filter("doc_id is not null").filter("text not like '<%'")
    got = lm.id_counts(lm.word_counts(docs), tokenizer_path())
    want = Counter(x for r in docs.collect() for w in spaced(lower(r["text"])) for x in own.encode(" " + w, add_special_tokens=False).ids)
    want[lm.END] = docs.count()
    assert {i: int(n) for i, n in enumerate(got) if n} == dict(want)


def test_nothing_learnt_and_empty_tables(spark, tables):
    got = queries.queries()["op11_attention"](spark, f"{tables}/held").collect()
    assert got and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"] for r in got)
    for r in got:
        assert abs(r["base_score"]) < 1e-9 * r["n_tokens"]
    assert queries.queries()["op11_attention"](spark, f"{tables}/empty").count() == 0


def test_scores_do_not_depend_on_partitions(spark, tables):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    learnt = ~lm.held_out(F.col("doc_id"))
    a, b = (sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 2)) for r in lm.scores(d, learnt).collect()) for d in (docs.coalesce(1), docs.repartition(7)))
    assert a == b


def test_all_windows_of_all_training_documents_teach(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/full/documents.parquet")
    monkeypatch.setattr(lm, "SHARD", 64)
    taught, trained = [], attention.train

    def counting(*args):
        taught.append(args)
        return trained(*args)

    counts = lm.word_counts(docs)
    ids = lm.id_counts(counts, tokenizer_path())
    v = attention.vocabulary(ids, lm.END)
    monkeypatch.setattr(lm, "fitted", lambda rows, v: taught.append(rows.collect()) or attention.started(v))
    lm.scores(docs, F.lit(True)).count()
    windows = lm.unpacked(np.array([r["blocks"] for r in taught[0]], np.int64), [bytes(r["line"]) for r in taught[0]])
    following = windows[:, 2]
    assert np.array_equal(np.bincount(following[following != v.pad], minlength=v.pad), np.bincount(v.rank, ids, v.pad).astype(int))
    # nothing but the row's end comes before its first window, and each other one has the block before it
    first = windows[:, 0, 0] == v.pad
    assert first.sum() == docs.count() and (windows[first, 1, 0] == v.rank[lm.END]).all()
    # a shard trains on each of its windows
    monkeypatch.setattr(attention, "train", counting)
    monkeypatch.setattr(lm, "BATCH", 100)
    monkeypatch.setattr(lm, "STEPS", 3)
    taught.clear()
    rows = lm.training_lines(docs, v, tokenizer_path()).toArrow()
    lm._trainer(attention.started(v), v)(rows)
    assert taught[0][3] * taught[0][4] >= len(windows) == len(taught[0][2])


def test_lines_are_scored_as_whole_texts_are(model):
    _, v, m = model
    rng = np.random.default_rng(5)
    counts, end, n = np.array([0, 1, 7, 8, 300, 9]), int(v.rank[7]), 2
    ranks = v.rank[rng.integers(0, 12, int(counts.sum()))].astype(np.int16)
    _, following, starts = attention.blocks(ranks, counts, end, v.pad)
    lead = np.full(BLOCK + 1, v.pad, np.int16)
    lead[-1] = end
    lines, sizes, rows = [], [], []
    for row, (x, y) in enumerate(zip(starts, [*starts[1:], len(following)])):
        line = np.concatenate([lead, following[x:y].ravel()])
        for at in range(0, int(y - x), n):
            sizes.append(min(n, int(y - x) - at))
            rows.append(row)
            lines.append(line[at * BLOCK : (at + sizes[-1] + 1) * BLOCK + 1])
    got = attention.score_lines(m, np.array(sizes), np.concatenate(lines), at_once=3, together=2)
    assert np.allclose(np.bincount(rows, got), attention.score(m, ranks, counts, end), rtol=1e-5)


def test_large_logits_are_summed_without_overflow():
    logits = np.array([[200.0, 0, -300], [-200, -201, -202], [1, 2, 3]], np.float32)
    sums, off = attention._exponentials(logits.copy())
    assert np.allclose(off + np.log(sums), np.logaddexp.reduce(logits.astype(float), axis=1))


def test_texts_are_encoded_once(spark, tables, monkeypatch):
    """One pass counts words and one encodes: training and scoring read the ranks that it stored."""
    read, mapped = [], lm.mapped
    monkeypatch.setattr(lm, "mapped", lambda df, *rest: read.append("text" in df.columns) or mapped(df, *rest))
    lm.scores(spark.read.parquet(f"{tables}/full/documents.parquet"), ~lm.held_out(F.col("doc_id")))
    assert sum(read) == 2
