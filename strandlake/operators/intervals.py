"""Interval and coding-region metrics. Intervals are half-open; the sample is the pairing key, the sequence's name is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("cluster_tp", "cluster_fp", "cluster_fn", "orf_n_gt_cds", "orf_covered_cds", "orf_n_pred_cds", "orf_correct_pred_cds")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """(1 + b²)PR / (b²P + R), 0 where that has no denominator."""
    b2 = beta * beta
    return F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def f_scores(p: Column, r: Column, prefix: str) -> list[Column]:
    return [f_beta(p, r, b).alias(f"{prefix}_{n}") for n, b in (("f1", 1.0), ("f2", 2.0), ("f05", 0.5))]


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)


def _touching(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    o = other.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    cond = [rows[k].eqNullSafe(o[k]) for k in keys]
    return rows.join(o, [*cond, overlap(rows["start"], rows["end"], o["_s"], o["_e"])], "left_semi")


def cluster_eval(samples: DataFrame, truth: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Per sample: predictions that touch a true region (TP) or none (FP), true regions that no prediction touches
    (FN), precision, recall and F scores. ``samples`` lists the keys, so that one without a prediction has a row."""
    k = list(keys)
    tp = _touching(predicted, truth, k).groupBy(*k).agg(F.count("*").alias("tp"))
    n_pred = predicted.groupBy(*k).agg(F.count("*").alias("n_pred"))
    hit = _touching(truth, predicted, k).groupBy(*k).agg(F.count("*").alias("hit"))
    n_true = truth.groupBy(*k).agg(F.count("*").alias("n_true"))
    out = samples.select(*k)
    for part in (tp, n_pred, hit, n_true):
        out = out.join(part, k, "left")
    out = out.fillna(0, ["tp", "n_pred", "hit", "n_true"])
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("hit")
    out = out.select(*k, tp.alias("cluster_tp"), fp.alias("cluster_fp"), fn.alias("cluster_fn"))
    tp, fp, fn = (F.col(c) for c in COUNTS[:3])
    out = out.withColumn("cluster_precision", ratio(tp, tp + fp)).withColumn("cluster_recall", ratio(tp, tp + fn))
    return out.select("*", *f_scores(F.col("cluster_precision"), F.col("cluster_recall"), "cluster"))


def orf_eval(samples: DataFrame, coding: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Per sample, by coding region: recall is the share of true ones that some prediction covers; precision is the
    mean over predictions of their own share of true ones (0 for a prediction that touches none). A coding region
    under two predictions counts for both. ``coding``: (keys, locus_tag, start, end, in_gt)."""
    k = list(keys)
    true = coding.filter("in_gt").select(*k, "locus_tag", "start", "end").distinct()
    n_gt = true.groupBy(*k).agg(F.countDistinct("locus_tag").alias("orf_n_gt_cds"))
    covered = _touching(true, predicted, k).groupBy(*k).agg(F.countDistinct("locus_tag").alias("orf_covered_cds"))
    tags = true.select(*k, "locus_tag").distinct().withColumn("_true", F.lit(1))
    regions = predicted.withColumn("_region", F.struct("start", "end", F.monotonically_increasing_id()))
    c = coding.select(*(F.col(x).alias(f"_{x}") for x in k), "locus_tag", F.col("start").alias("_s"), F.col("end").alias("_e"))
    cond = [regions[x].eqNullSafe(c[f"_{x}"]) for x in k]
    under = regions.join(c, [*cond, overlap(regions["start"], regions["end"], c["_s"], c["_e"])], "left").join(tags, [*k, "locus_tag"], "left")
    each = under.groupBy(*k, "_region").agg(F.count("locus_tag").alias("n"), F.count("_true").alias("correct"))
    total = each.groupBy(*k).agg(
        F.sum("n").alias("orf_n_pred_cds"), F.sum("correct").alias("orf_correct_pred_cds"), F.avg(ratio(F.col("correct"), F.col("n")).cast("decimal(28,12)")).cast("double").alias("orf_avg_precision_t")
    )
    out = samples.select(*k).join(n_gt, k, "left").join(covered, k, "left").join(total, k, "left")
    out = out.fillna(0, ["orf_n_gt_cds", "orf_covered_cds", "orf_n_pred_cds", "orf_correct_pred_cds"]).fillna(0.0, ["orf_avg_precision_t"])
    out = out.withColumn("orf_avg_recall_t", ratio(F.col("orf_covered_cds"), F.col("orf_n_gt_cds")))
    return out.select("*", *f_scores(F.col("orf_avg_precision_t"), F.col("orf_avg_recall_t"), "orf"))


def micro(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the counts over all samples, then ratios; no row on empty input."""
    sums = rows.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS)).filter(F.col(COUNTS[0]).isNotNull())
    tp, fp, fn, n_gt, covered, n_pred, correct = (F.col(c) for c in COUNTS)
    out = sums.select("*", ratio(tp, tp + fp).alias("cluster_precision"), ratio(tp, tp + fn).alias("cluster_recall"), ratio(correct, n_pred).alias("orf_precision"), ratio(covered, n_gt).alias("orf_recall"))
    return out.select("*", *f_scores(F.col("cluster_precision"), F.col("cluster_recall"), "cluster"), *f_scores(F.col("orf_precision"), F.col("orf_recall"), "orf"))


def macro(rows: DataFrame) -> DataFrame:
    """Means of the samples' ratios, nulls left out, then F scores of the means; no row on empty input."""
    exact = lambda c: F.avg(F.col(c).cast("decimal(28,12)")).cast("double").alias(c)
    means = rows.agg(*(exact(c) for c in ("cluster_precision", "cluster_recall", "orf_avg_precision_t", "orf_avg_recall_t")), F.count("*").alias("_n")).filter("_n > 0").drop("_n")
    return means.select("*", *f_scores(F.col("cluster_precision"), F.col("cluster_recall"), "cluster"), *f_scores(F.col("orf_avg_precision_t"), F.col("orf_avg_recall_t"), "orf"))


def presented(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded half to even, for display."""
    return rows.select(*(F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
