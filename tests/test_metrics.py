import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import decoding, intervals


def regions(spark, rows):
    return spark.createDataFrame([("s", a, b) for a, b in rows], "sample string, start long, end long")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([("s",)], "sample string")


@pytest.mark.parametrize("true,pred,want", [([(100, 200)], [(120, 180)], (1, 0, 0, 1.0)), ([(100, 200)], [(300, 400)], (0, 1, 1, 0.0)), ([(0, 10), (20, 30)], [(0, 30)], (1, 0, 0, 1.0)), ([(0, 10)], [], (0, 0, 1, 0.0))])
def test_cluster_eval(spark, one, true, pred, want):
    r = intervals.cluster_eval(one, regions(spark, true), regions(spark, pred)).first()
    assert (r["cluster_tp"], r["cluster_fp"], r["cluster_fn"], r["cluster_f1"]) == want


def test_orf_eval(spark, one):
    cds = spark.createDataFrame([("s", t, a, b, g) for t, a, b, g in (("a", 0, 10, True), ("b", 10, 20, True), ("c", 20, 30, False))], "sample string, locus_tag string, start long, end long, in_gt boolean")
    r = intervals.orf_eval(one, cds, regions(spark, [(0, 20)])).first()
    assert (r["orf_avg_recall_t"], r["orf_avg_precision_t"], r["orf_f1"]) == (1, 1, 1)
    r = intervals.orf_eval(one, cds, regions(spark, [])).first()
    assert (r["orf_n_gt_cds"], r["orf_n_pred_cds"], r["orf_avg_recall_t"], r["orf_f1"]) == (2, 0, 0, 0)
    r = intervals.orf_eval(one, cds, regions(spark, [(0, 30), (15, 25), (50, 60)])).first()
    assert (r["orf_n_pred_cds"], r["orf_correct_pred_cds"]) == (5, 3) and abs(r["orf_avg_precision_t"] - (2 / 3 + 1 / 2 + 0) / 3) < 1e-9


def test_micro_and_macro(spark):
    row = (1, 0, 0, 1.0, 1.0, 1.0, 1.0, 2, 2, 2, 2)
    df = spark.createDataFrame([row] * 3, "cluster_tp int, cluster_fp int, cluster_fn int, cluster_precision double, cluster_recall double, orf_avg_precision_t double, orf_avg_recall_t double, orf_n_gt_cds int, orf_covered_cds int, orf_n_pred_cds int, orf_correct_pred_cds int")
    assert intervals.micro(df).first()["cluster_f1"] == intervals.macro(df).first()["orf_f1"] == 1
    assert intervals.micro(df.limit(0)).count() == intervals.macro(df.limit(0)).count() == 0
    half = df.withColumn("cluster_recall", F.lit(None).cast("double")).unionByName(df)
    assert intervals.macro(half).first()["cluster_recall"] == 1
    assert intervals.presented(spark.createDataFrame([(0.03125,)], "x double")).first()["x"] == 0.0312


def test_f_beta(spark):
    r = spark.range(1).select(intervals.f_beta(F.lit(0.0), F.lit(0.0), 1).alias("a"), intervals.f_beta(F.lit(0.5), F.lit(0.5), 1).alias("b")).first()
    assert (r["a"], r["b"]) == (0, 0.5)


def test_decoding(spark):
    orfs = spark.createDataFrame([("s", i, 100 * i, 100 * i + 90) for i in range(7)], "sample string, orf_idx long, start long, end long")
    ann = spark.createDataFrame([("s", 0, 0.9), ("s", 0, 0.2), ("s", 1, 0.8), ("s", 3, 0.5), ("s", 5, 0.7), ("s", 6, 0.6), ("s", 4, -1.0)], "sample string, orf_idx long, score double")
    scored = decoding.per_orf_max(orfs, ann)
    assert [r["score"] for r in scored.orderBy("orf_idx").collect()] == [0.9, 0.8, 0, 0.5, 0, 0.7, 0.6]
    assert sorted(tuple(r)[1:] for r in decoding.decode(scored, 0.5).collect()) == [(0, 2), (3, 4), (5, 7)]
    assert sorted(tuple(r)[1:] for r in decoding.decode(scored, 0.6, nucleotide=True).collect()) == [(0, 190), (500, 690)]
    assert [tuple(r)[1:] for r in decoding.decode(scored, 0.0).collect()] == [(0, 7)]


@pytest.mark.parametrize("block", [4, 4096])
def test_regions_of_all_thresholds(spark, monkeypatch, block):
    monkeypatch.setattr(decoding, "BLOCK", block)
    rng, steps = np.random.default_rng(block), [0.0, 0.1, 0.25, 0.5, 0.7, 1.0]
    rows = [(s, i, 100 * i + 3, 100 * i + 90, float(rng.integers(-1, 11)) / 10) for s, n in (("s", 60), ("t", 25), ("u", 1)) for i in range(n) if rng.random() < 0.95]
    scored = spark.createDataFrame(rows, "sample string, orf_idx int, start int, end int, score double").repartition(3)
    found = decoding.regions_by_threshold(scored, steps).collect()
    for k, t in enumerate(steps, 1):
        want = sorted(tuple(r) for r in decoding.decode(scored, t, nucleotide=True).collect())
        assert sorted((r["sample"], r["start"], r["end"]) for r in found if r["above"] < k <= r["upto"]) == want
    assert len({(r["sample"], r["first"], r["last"]) for r in found}) == len(found) <= len(rows)


def test_sweep_equals_counts_of_each_threshold(spark, monkeypatch):
    monkeypatch.setattr(decoding, "BLOCK", 8)
    rng, names = np.random.default_rng(5), ["s", "t", "lonely"]
    orfs = spark.createDataFrame([(s, i, 10 * i, 10 * i + 8) for s in names[:2] for i in range(40)], "sample string, orf_idx long, start long, end long")
    ann = spark.createDataFrame([(s, i, float(rng.random())) for s in names[:2] for i in range(40)], "sample string, orf_idx long, score double")
    truth = spark.createDataFrame([("s", 20, 95), ("s", 90, 130), ("t", 300, 320), ("lonely", 0, 5), ("unknown", 0, 5)], "sample string, start long, end long")
    coding = orfs.select("sample", F.concat(F.lit("c"), F.expr("orf_idx div 2")).alias("locus_tag"), "start", "end", (F.col("orf_idx") % 5 == 0).alias("in_gt"))
    known = spark.createDataFrame([(s,) for s in names], "sample string")
    steps = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.9,), (1.0,), (None,)], "threshold double")
    got = {r["threshold"]: r for r in decoding.sweep(known, orfs, ann, truth, coding, steps).collect()}
    scored = decoding.per_orf_max(orfs, ann)
    for t in (0.0, 0.2, 0.5, 0.9, 1.0):
        pred = decoding.decode(scored, t, nucleotide=True)
        c, o = intervals.cluster_eval(known, truth.filter("sample <> 'unknown'"), pred), intervals.orf_eval(known, coding, pred)
        want = {n: sum(r[n] for r in df.collect()) for df, some in ((c, intervals.COUNTS[:3]), (o, intervals.COUNTS[3:])) for n in some}
        assert {n: got[t][n] for n in intervals.COUNTS} == want
    assert (got[None]["cluster_tp"], got[None]["cluster_fn"], got[None]["orf_n_pred_cds"]) == (0, 4, 0)


def test_curves(spark):
    rng = np.random.default_rng(0)
    rows = [(float(round(s, 1)), int(t)) for s, t in zip(rng.random(60), rng.random(60) < 0.4)]
    df = spark.createDataFrame(rows, "score double, target int")
    positives, last, want = sum(t for _, t in rows), 0.0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        called = [t for x, t in rows if x >= s]
        want += (sum(called) / positives - last) * sum(called) / len(called)
        last = sum(called) / positives
    assert abs(decoding.average_precision(df).first()[0] - want) < 1e-9
    assert decoding.average_precision(df.withColumn("target", F.lit(0))).first()[0] == 0
    assert decoding.pr_curve(df).filter("recall = 0 and precision = 1 and threshold = 1").count() == 1
    with pytest.raises(ValueError):
        decoding.sweep_area(df, "other")


def test_focal_loss(spark):
    rows = [(0.3, 1, 1), (-2.0, 0, 0), (5.0, 0, 1)]
    df = spark.createDataFrame(rows, "logit double, target int, keep int")

    def loss(x, y, a, g=2.0):
        p = 1 / (1 + math.exp(-x))
        pt = p if y else 1 - p
        return (1 if a is None else a if y else 1 - a) * (1 - pt) ** g * -math.log(pt)

    want = [loss(x, y, 0.25) for x, y, _ in rows]
    assert abs(decoding.focal_loss(df).first()[0] - sum(want) / 3) < 1e-9
    assert abs(decoding.focal_loss(df, reduction="sum").first()[0] - sum(want)) < 1e-9
    assert abs(decoding.focal_loss(df, alpha=None, mask="keep").first()[0] - (loss(0.3, 1, None) + loss(5.0, 0, None)) / 2) < 1e-9
    assert decoding.focal_loss(df.withColumn("keep", F.lit(0)), mask="keep").first()[0] == 0
    with pytest.raises(ValueError):
        decoding.focal_loss(df, alpha=2.0)
