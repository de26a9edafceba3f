"""Score decoding, threshold sweeps, precision-recall curves and the focal loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.operators import intervals
from strandlake.shared import cut


def per_orf_max(orfs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(sample, orf_idx, start, end, score): the greatest annotation score of each reading frame, 0 at least."""
    best = annotations.groupBy("sample", "orf_idx").agg(F.max("score").alias("best"))
    return orfs.join(best, ["sample", "orf_idx"], "left").select("sample", "orf_idx", "start", "end", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("score"))


def decode(scored: DataFrame, threshold: float | None = None, nucleotide: bool = False) -> DataFrame:
    """Stretches of consecutive frames at or over the threshold (gaps and islands).

    (sample[, threshold], start, end): frame numbers [first, last + 1), or with
    ``nucleotide`` the first frame's start to the last one's end. Without a
    ``threshold`` rows carry their own in a column.
    """
    keys = ["sample"] if threshold is not None else ["threshold", "sample"]
    least = F.lit(threshold) if threshold is not None else F.col("threshold")
    called = scored.filter(F.col("score") >= least)
    island = F.col("orf_idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("orf_idx"))
    ends = (F.min_by("start", "orf_idx"), F.max_by("end", "orf_idx")) if nucleotide else (F.min("orf_idx"), F.max("orf_idx") + 1)
    return called.withColumn("_island", island).groupBy(*keys, "_island").agg(ends[0].cast("long").alias("start"), ends[1].cast("long").alias("end")).drop("_island")


def grid(spark, step: float = 0.005) -> DataFrame:
    """(threshold): from 0 to 1 in steps."""
    n = round(1 / step)
    return spark.range(n + 1).select((F.col("id").cast("double") * F.lit(step)).alias("threshold"))


#: Consecutive frames of a sample that are looked at together; longer samples are parted there and their regions joined again.
BLOCK = 4096


def _nearest_less(level: np.ndarray, step: int, ties: bool) -> np.ndarray:
    """For each place the nearest one before it (``step`` -1) or after it (1) whose level is less, or with ``ties`` as low;
    0 stands at both ends. All places jump at once, over what places between have already passed."""
    near = np.arange(len(level)) + step
    near[[0, -1]] = 0, len(level) - 1
    over = np.greater if ties else np.greater_equal
    left = np.flatnonzero(level)
    while len(left := left[over(level[near[left]], level[left])]):
        near[left] = near[near[left]]
    return near


def _regions(thresholds: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Regions of sorted frames (sample, orf_idx, start, end, score), each with the thresholds between which it lives."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sample, index = batch.column("sample"), batch.column("orf_idx").to_numpy()
            level = np.searchsorted(thresholds, batch.column("score").to_numpy(), "right")
            other = np.ones(batch.num_rows - 1, bool)
            if len(other):
                same = pc.equal(sample.slice(0, batch.num_rows - 1), sample.slice(1))
                other = ~same.fill_null(False).to_numpy(zero_copy_only=False) | (np.diff(index) != 1)
            # a place of level 0 before each stretch of frames and after the last one
            place = np.arange(batch.num_rows) + 1 + np.cumsum(np.r_[False, other])
            at = np.zeros(place[-1] + 2, np.int64)
            at[place] = level
            frame = np.full(len(at), -1)
            frame[place] = np.arange(batch.num_rows)
            before, after = _nearest_less(at, -1, True), _nearest_less(at, 1, False)
            # the first of a region's lowest frames stands for it
            own = np.flatnonzero((at > 0) & (at[before] < at))
            first, last = frame[before[own] + 1], frame[after[own] - 1]
            # where this batch or a block ends, the region may go on elsewhere
            inner = (first > 0) & (last < batch.num_rows - 1) & ((index[first] % BLOCK != 0) | (index[first] == 0)) & (index[last] % BLOCK != BLOCK - 1)
            columns = [sample.take(pa.array(first)), index[first], index[last], batch.column("start").take(pa.array(first)), batch.column("end").take(pa.array(last))]
            columns += [np.maximum(at[before[own]], at[after[own]]), at[own], ~inner]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["sample", "first", "last", "start", "end", "above", "upto", "open"])

    return found


def regions_by_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(sample, first, last, start, end, above, upto): every region that ``decode`` gives at some threshold, once.

    It is one at the thresholds numbered above + 1 to upto, in rising order from 1.
    Frames (sample, orf_idx, start, end, score) are numbered from 0 in their sample.
    As the threshold falls, regions are born, grow and merge: a region lives from its
    lowest frame's score down to the higher of the two frames beside it, so there
    are no more of them than frames, however many thresholds there are. A long
    sample is dealt out in blocks of frames; what touches a block's end is joined
    across blocks at each threshold, some two rows a block and threshold.
    """
    called = scored.filter(F.col("score") >= F.lit(min(thresholds, default=float("nan")))).select("sample", F.col("orf_idx").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("score").cast("double"))
    block = F.greatest(F.floor(F.col("orf_idx") / BLOCK), F.lit(0))
    dealt = called.repartition("sample", block).sortWithinPartitions("sample", "orf_idx")
    counted = [T.StructField(c, T.LongType()) for c in ("first", "last", "start", "end", "above", "upto")]
    pieces = cut(dealt.mapInArrow(_regions(sorted(thresholds)), T.StructType([called.schema["sample"], *counted, T.StructField("open", T.BooleanType())])))
    at = pieces.filter("open").withColumn("k", F.explode(F.sequence(F.col("above") + 1, F.col("upto"))))
    along = Window.partitionBy("sample", "k").orderBy("first")
    begins = F.coalesce(F.lag("last").over(along) + 1 != F.col("first"), F.lit(True)).cast("long")
    chained = at.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = chained.groupBy("sample", "k", "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("start", "first").alias("start"), F.max_by("end", "last").alias("end"))
    joined = joined.groupBy("sample", "first", "last", "start", "end").agg((F.min("k") - 1).alias("above"), F.max("k").alias("upto"))
    return pieces.filter("not open").drop("open").unionByName(joined)


def _lives(rows: DataFrame, **counts: Column) -> DataFrame:
    """(k, counts): what begins to count at threshold k, and from which on it doesn't."""
    first = F.struct((F.col("above") + 1).alias("k"), *(c.cast("long").alias(n) for n, c in counts.items()))
    then = F.struct((F.col("upto") + 1).alias("k"), *((-c.cast("long")).alias(n) for n, c in counts.items()))
    return rows.select(F.explode(F.array(first, then)).alias("e")).groupBy("e.k").agg(*(F.sum(f"e.{n}").alias(n) for n in counts))


def _ever(rows: DataFrame, *keys: str) -> DataFrame:
    """(above, upto) without overlaps of a key: the thresholds at which at least one of its rows lives."""
    order = Window.partitionBy(*keys).orderBy("above", "upto").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.greatest(F.col("above"), F.coalesce(F.max("upto").over(order), F.lit(0)))
    return rows.select(begun.alias("above"), "upto").filter("above < upto")


def sweep(samples: DataFrame, orfs: DataFrame, annotations: DataFrame, truth: DataFrame, coding: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A row per threshold: counts over all samples, ratios and F1 for regions and coding regions.

    Thresholds are a short list, read by the driver. Neither frames nor regions are
    repeated by threshold: each region of any threshold meets the true and the coding
    regions of its sample once, and counts are sums of what begins and ends at each
    threshold. Samples without a prediction still count their true regions. A null or
    NaN threshold counts nothing as predicted.
    """
    known = samples.select("sample").distinct()
    of = lambda df: df.join(known, "sample", "left_semi")
    listed = thresholds.select(F.col("threshold").cast("double").alias("threshold")).distinct()
    steps = sorted(r[0] for r in listed.filter("threshold is not null and not isnan(threshold)").collect())
    predicted = regions_by_threshold(of(per_orf_max(orfs, annotations)), steps).drop("first", "last")
    real = cut(of(truth).select("sample", "start", "end").withColumn("real", F.monotonically_increasing_id()))
    coded = cut(of(coding).select("sample", "locus_tag", "start", "end", "in_gt"))

    def met(other: DataFrame, how: str = "inner") -> DataFrame:
        o = other.withColumnsRenamed({"sample": "of", "start": "from", "end": "to"})
        return predicted.join(o, (F.col("sample") == F.col("of")) & intervals.overlap(F.col("start"), F.col("end"), F.col("from"), F.col("to")), how)

    one = F.lit(1)
    true = coded.filter("in_gt").select("sample", "locus_tag", "start", "end").distinct()
    tags = true.select("sample", "locus_tag").distinct()
    under = met(coded.join(tags.withColumn("true", one), ["sample", "locus_tag"], "left"))
    parts = [
        _lives(predicted, n_pred=one),
        _lives(met(real, "left_semi"), tp=one),
        _lives(_ever(met(real), "real"), hit=one),
        _lives(_ever(met(true), "sample", "locus_tag"), orf_covered_cds=one),
        _lives(under, orf_n_pred_cds=F.col("locus_tag").isNotNull(), orf_correct_pred_cds=F.col("true").isNotNull()),
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part, allowMissingColumns=True)
    names = ["n_pred", "tp", "hit", "orf_covered_cds", "orf_n_pred_cds", "orf_correct_pred_cds"]
    counted = counted.groupBy("k").agg(*(F.sum(n).alias(n) for n in names))  # a row for each threshold at most
    spark = predicted.sparkSession
    numbered = spark.createDataFrame([(i + 1, t) for i, t in enumerate(steps)], "k long, step double")
    down = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = numbered.join(counted, "k", "left").select("step", *(F.sum(F.coalesce(n, F.lit(0))).over(down).alias(n) for n in names))
    whole = real.agg(F.count("*").alias("n_true")).crossJoin(tags.agg(F.count("locus_tag").alias("orf_n_gt_cds")))  # one row
    out = thresholds.crossJoin(F.broadcast(whole)).join(F.broadcast(held), F.col("threshold") == F.col("step"), "left").fillna(0, names)
    rows = out.select("threshold", F.col("tp").alias("cluster_tp"), (F.col("n_pred") - F.col("tp")).alias("cluster_fp"), (F.col("n_true") - F.col("hit")).alias("cluster_fn"), *intervals.COUNTS[3:])
    out = intervals.micro(rows, ("threshold",))
    return out.select("threshold", *intervals.COUNTS, "cluster_precision", "cluster_recall", "cluster_f1", "orf_precision", "orf_recall", "orf_f1")


def sweep_area(rows: DataFrame, kind: str) -> DataFrame:
    """Area under the sweep's precision over recall by trapezoids, for ``cluster`` or ``orf``.

    Points are ordered by recall, then precision downwards, then threshold. The
    sweep has one row per threshold, so the single ordered group is that short.
    """
    if kind not in ("cluster", "orf"):
        raise ValueError(f"no curve of kind {kind!r}")
    r, p = F.col(f"{kind}_recall"), F.col(f"{kind}_precision")
    order = Window.orderBy(r, F.desc(f"{kind}_precision"), "threshold")
    part = (r - F.lag(r).over(order)) * (p + F.lag(p).over(order)) / 2
    return rows.select(part.cast("decimal(28,14)").alias("part")).agg(F.coalesce(F.sum("part"), F.lit(0)).cast("double").alias("aucpr"))


def _running(at: DataFrame, splits: int = 256) -> DataFrame:
    """Distinct scores (score, hits, n) with tp and called, the sums from the top down to each, and all positives.

    Scores are dealt into ranges between approximate quantiles; the sums run
    inside each range, and only the ranges' totals meet in one task. Where the
    quantiles fall doesn't change a result.
    """
    cuts = at.agg(F.percentile_approx("score", [i / splits for i in range(1, splits)], 10_000).alias("cuts"), F.sum("hits").alias("positives"))
    dealt = at.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("score")))).drop("cuts")
    totals = dealt.groupBy("range").agg(F.sum("hits").alias("h"), F.sum("n").alias("c"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("range", F.coalesce(F.sum("h").over(above), F.lit(0)).alias("h"), F.coalesce(F.sum("c").over(above), F.lit(0)).alias("c"))
    down = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("tp", F.sum("hits").over(down)).withColumn("called", F.sum("n").over(down))
    return inside.join(F.broadcast(offset), "range").select("score", "hits", "n", (F.col("tp") + F.col("h")).alias("tp"), (F.col("called") + F.col("c")).alias("called"), "positives")


def _by_score(scored: DataFrame) -> DataFrame:
    return _running(scored.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum(F.col("target").cast("long")).alias("hits"), F.count("*").alias("n")))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at every distinct score of (score, target), and the closing point (1, 0) at threshold 1; ties stand together."""
    points = _by_score(scored).select(F.col("score").alias("threshold"), (F.col("tp") / F.col("called")).alias("precision"), intervals.ratio(F.col("tp"), F.col("positives")).alias("recall"))
    end = scored.sparkSession.range(1).select(F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the sum over distinct scores of the gain in recall times the precision; 0 without positives."""
    gain = intervals.ratio(F.col("hits"), F.col("positives"))
    part = (gain * (F.col("tp") / F.col("called"))).cast("decimal(28,14)")
    return _by_score(scored).select(part.alias("part")).agg(F.coalesce(F.sum("part"), F.lit(0)).cast("double").alias("average_precision"))


def focal(logit: Column, target: Column, gamma: float = 2.0, alpha: float | None = 0.25) -> Column:
    """(1 - p_t)^gamma times the stable binary cross entropy, weighted by alpha for 1 and 1 - alpha for 0."""
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    entropy = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    p = 1 / (1 + F.exp(-logit))
    pt = p * target + (1 - p) * (1 - target)
    loss = F.pow(1 - pt, F.lit(gamma)) * entropy
    return loss if alpha is None else (alpha * target + (1 - alpha) * (1 - target)) * loss


def focal_loss(rows: DataFrame, gamma: float = 2.0, alpha: float | None = 0.25, reduction: str = "mean", mask: str | None = None) -> DataFrame:
    """Loss of rows (logit, target[, mask]): each row's (``none``), or one row with the ``sum`` or ``mean``; a masked
    mean divides by the masked rows, one at least."""
    loss = focal(F.col("logit"), F.col("target").cast("double"), gamma, alpha)
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    each = rows.withColumn("loss", loss * weight)
    if reduction == "none":
        return each
    total = F.sum(F.col("loss").cast("decimal(28,14)")).cast("double")
    if reduction == "sum":
        return each.agg(total.alias("loss"))
    if reduction != "mean":
        raise ValueError(f"no reduction {reduction!r}")
    return each.agg((total / (F.greatest(F.sum(weight), F.lit(1.0)) if mask else F.count("*"))).alias("loss"))
