"""Ontology closure, information content and semantic similarity, as joins over (term, ancestor, dist)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.shared import cut

MAX_DEPTH = 64


def closure(terms: DataFrame, is_a: DataFrame, defined_only: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(term, ancestor, dist): each term with itself and all above it, at the least distance.

    ``terms``: (id); ``is_a``: (child, parent). ``defined_only`` leaves out parents
    that aren't terms. One join per level of the ontology, until a level adds
    nothing; levels are checkpointed, so the plan doesn't grow with the depth.
    """
    steps = is_a.select("child", "parent").distinct()
    if defined_only:
        steps = steps.join(terms.select(F.col("id").alias("parent")), "parent", "left_semi")
    level = terms.select(F.col("id").alias("term"), F.col("id").alias("ancestor"), F.lit(0).alias("dist"))
    out = level
    for d in range(1, max_depth + 1):
        above = level.join(steps, level["ancestor"] == steps["child"]).select("term", F.col("parent").alias("ancestor"), F.lit(d).alias("dist")).distinct()
        level = cut(above.join(out.select("term", "ancestor"), ["term", "ancestor"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"no end after {max_depth} levels: the ontology has a cycle or is too deep")


def depths(terms: DataFrame, is_a: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, depth): least distance from a root, 0 where no root is reached."""
    roots = terms.join(is_a.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("ancestor"))
    found = closed.join(roots, "ancestor").groupBy("term").agg(F.min("dist").alias("depth"))
    return terms.select(F.col("id").alias("term")).join(found, "term", "left").fillna(0, ["depth"])


def ancestors(closed: DataFrame) -> DataFrame:
    return closed.filter("dist > 0")


def descendants(closed: DataFrame) -> DataFrame:
    """(term, descendant, dist)."""
    return closed.filter("dist > 0").select(F.col("ancestor").alias("term"), F.col("term").alias("descendant"), "dist")


def information_content(counts: DataFrame, closed: DataFrame, total: int) -> DataFrame:
    """(term, ic): direct counts (term, cnt) added to every ancestor once per annotated term, -log2(min(count / total, 1));
    no rows for a total of 0 or less. Counted terms outside the ontology keep their own count."""
    if total <= 0:
        return counts.select("term", F.lit(0.0).alias("ic")).limit(0)
    known = counts.join(closed, "term").select(F.col("ancestor").alias("term"), "cnt")
    other = counts.join(closed.select("term").distinct(), "term", "left_anti").select("term", "cnt")
    summed = known.unionByName(other).groupBy("term").agg(F.sum("cnt").alias("cnt"))
    share = F.least(F.col("cnt") / F.lit(total), F.lit(1.0))
    return summed.filter("cnt > 0").select("term", (-F.log2(share) + F.lit(0.0)).alias("ic"))


def resnik(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(t1, t2, resnik): the greatest information content of a common ancestor; a term with itself has its own, and 0 stands for none."""
    # the value is the same either way, so each pair is looked at once
    low, high = F.least("t1", "t2"), F.greatest("t1", "t2")
    once = pairs.filter("t1 <> t2").select(low.alias("t1"), high.alias("t2")).distinct()
    # a term's ancestors travel as one array, so a pair of terms stays one row
    above = closed.join(ic.withColumnRenamed("term", "ancestor"), "ancestor").groupBy("term").agg(F.collect_set(F.struct("ic", "ancestor")).alias("up"))
    met = once.join(above.select(F.col("term").alias("t1"), F.col("up").alias("u1")), "t1").join(above.select(F.col("term").alias("t2"), F.col("up").alias("u2")), "t2")
    best = met.select(F.col("t1").alias("low"), F.col("t2").alias("high"), F.array_max(F.array_intersect("u1", "u2"))["ic"].alias("best"))
    own = ic.select(F.col("term").alias("t1"), F.col("ic").alias("own"))
    out = pairs.withColumns({"low": low, "high": high}).join(best, ["low", "high"], "left").join(own, "t1", "left")
    value = F.when(F.col("t1") == F.col("t2"), F.col("own")).otherwise(F.col("best"))
    return out.select("t1", "t2", F.coalesce(value, F.lit(0.0)).alias("resnik"))


def lin(pairs: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(t1, t2, lin): min(2 MICA / (IC1 + IC2), 1), 0 where both are 0."""
    r = resnik(pairs, closed, ic)
    one = ic.select(F.col("term").alias("t1"), F.col("ic").alias("i1"))
    two = ic.select(F.col("term").alias("t2"), F.col("ic").alias("i2"))
    total = F.coalesce("i1", F.lit(0.0)) + F.coalesce("i2", F.lit(0.0))
    return r.join(one, "t1", "left").join(two, "t2", "left").select("t1", "t2", F.when(total > 0, F.least(2 * F.col("resnik") / total, F.lit(1.0))).otherwise(0.0).alias("lin"))


def _met(sets: DataFrame, compared: DataFrame, scored: DataFrame, value: str) -> DataFrame:
    """(a, b, t1, t2, value): the terms of entity a beside those of entity b, a row for each two that are scored."""
    met = compared.select("a", "b").join(sets.select(F.col("entity").alias("a"), F.col("term").alias("t1")), "a").join(sets.select(F.col("entity").alias("b"), F.col("term").alias("t2")), "b")
    return met.join(scored.select("t1", "t2", value), ["t1", "t2"])


def _mean(best: DataFrame, compared: DataFrame) -> DataFrame:
    mean = best.groupBy("a", "b").agg(F.avg(F.col("best").cast("decimal(28,14)")).cast("double").alias("score"))
    return compared.join(mean, ["a", "b"], "left").fillna(0.0, ["score"])


def best_match_average(sets: DataFrame, compared: DataFrame, scored: DataFrame, value: str) -> DataFrame:
    """(a, b, score): mean of both sides' best matches, pooled; 0 where a side has no term.

    ``sets``: (entity, term), distinct; ``compared``: (a, b); ``scored``: (t1, t2, value),
    the terms of a with those of b. The value is one for both ways, so the terms are
    expanded once, and dealt by entity pair once: both sides' maxima and the mean
    are taken where the rows then are.
    """
    met = _met(sets, compared, scored, value).repartition("a", "b")
    there, back = (met.groupBy("a", "b", F.col(t).alias("term")).agg(F.max(value).alias("best")) for t in ("t1", "t2"))
    return _mean(there.unionByName(back), compared)


def coverage(sets: DataFrame, compared: DataFrame, scored: DataFrame) -> DataFrame:
    """(a, b, score): mean over the terms of a, the target, of their best Lin match in b, the query."""
    return _mean(_met(sets, compared, scored, "lin").groupBy("a", "b", "t1").agg(F.max("lin").alias("best")), compared)


# -- whole sets side by side ---------------------------------------------------

#: Pairs of terms that a task holds, about, where each is wanted once.
_PAIR_ROWS = 1_000_000


def described(sets: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(entity, terms): the distinct terms of each entity as structs (term, own, up); ``sets``: (entity, term), repeats do no harm.

    ``up`` are the ancestors (ic, number) that can be a greatest common one of two different terms: those of some
    information content that two terms of the sets have at least. Terms are described where they are dealt by term,
    so that pairs of entities, and never pairs of terms, are what travels afterwards.
    """
    held = sets.select("entity", "term").filter("entity is not null and term is not null")
    above = closed.select("term", "ancestor").join(held.select("term").distinct(), "term", "left_semi").join(ic.filter("ic > 0").withColumnRenamed("term", "ancestor"), "ancestor")
    several = above.groupBy("ancestor").agg(F.count("*").alias("n")).filter("n > 1")
    several = cut(several.select("ancestor", F.monotonically_increasing_id().alias("number")))  # numbers are shorter than names
    up = cut(above.join(several, "ancestor").groupBy("term").agg(F.collect_set(F.struct("ic", "number")).alias("up")).join(ic.withColumnRenamed("ic", "own"), "term", "full"))
    named = held.join(up, "term", "left").select("entity", F.struct("term", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("up", F.array().cast(up.schema["up"].dataType)).alias("up")).alias("t"))
    return named.repartition("entity").groupBy("entity").agg(F.collect_set("t").alias("terms"))


def beside(sets: DataFrame, compared: DataFrame, closed: DataFrame, ic: DataFrame) -> DataFrame:
    """``compared`` with the described terms of a as ``x`` and of b as ``y``, null where there are none."""
    terms = described(sets, closed, ic)
    of = lambda end, name: terms.select(F.col("entity").alias(end), F.col("terms").alias(name))
    return compared.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")


def resnik_of(x: Column, y: Column) -> Column:
    """As ``resnik``, of two described terms."""
    common = F.array_max(F.array_intersect(x["up"], y["up"]))["ic"]
    return F.when(x["term"] == y["term"], x["own"]).otherwise(F.coalesce(common, F.lit(0.0)))


def lin_of(x: Column, y: Column) -> Column:
    """As ``lin``, of two described terms."""
    total = x["own"] + y["own"]
    return F.when(total > 0, F.least(2 * resnik_of(x, y) / total, F.lit(1.0))).otherwise(0.0)


def _matrix(met: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of ``beside`` with ``m``: the values of each term of a with each of b."""
    return met.withColumn("m", F.transform("x", lambda x: F.transform("y", lambda y: value(x, y)))).drop("x", "y")


def _mean_of(best: Column) -> Column:
    total = F.aggregate(best, F.lit(0).cast("decimal(30,14)"), lambda t, v: (t + v.cast("decimal(28,14)")).cast("decimal(30,14)"))
    return F.coalesce(F.when(F.size(best) > 0, (total / F.size(best)).cast("decimal(32,18)").cast("double")), F.lit(0.0))


def best_matches(met: DataFrame, value: Callable[[Column, Column], Column]) -> DataFrame:
    """As ``best_match_average``, of the rows of ``beside``: every pair of entities is one row, and both sides' best matches are taken in it."""
    there = F.transform("m", lambda row: F.array_max(row))
    back = F.transform(F.sequence(F.lit(0), F.size(F.col("m")[0]) - 1), lambda j: F.array_max(F.transform("m", lambda row: row[j])))
    return _matrix(met, value).select("a", "b", _mean_of(F.concat(there, back)).alias("score"))


def covered(met: DataFrame) -> DataFrame:
    """As ``coverage``, of the rows of ``beside``."""
    return _matrix(met, lin_of).select("a", "b", _mean_of(F.transform("m", lambda row: F.array_max(row))).alias("score"))


def lin_both_ways(met: DataFrame, rows: int) -> DataFrame:
    """(t1, t2, lin): once, and both ways, for each two terms of which one is a's and one is b's in any of the rows of ``beside``.

    Each two terms travel once, in the order of their names; the other way is made where they then are. ``rows`` is
    how many pairs there are about, so that no task holds more than a part of a bounded size of them.
    """
    one = met.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    valued = one.select(F.least("x.term", "y.term").alias("low"), F.greatest("x.term", "y.term").alias("high"), lin_of(F.col("x"), F.col("y")).alias("lin"))
    parts = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // _PAIR_ROWS))
    once = valued.repartition(parts, "low", "high").dropDuplicates(["low", "high"])
    ways = F.array(F.struct(F.col("low").alias("t1"), F.col("high").alias("t2")), F.struct(F.col("high").alias("t1"), F.col("low").alias("t2")))
    return once.select(F.explode(F.when(F.col("low") == F.col("high"), F.slice(ways, 1, 1)).otherwise(ways)).alias("p"), "lin").select("p.t1", "p.t2", "lin")


def by_greatest(scores: DataFrame, ic: DataFrame) -> DataFrame:
    """Scores divided by the greatest information content, 1 at most; 0 where that is 0 or missing."""
    most = ic.agg(F.coalesce(F.max("ic"), F.lit(0.0)).alias("_most"))
    value = F.when(F.col("_most") > 0, F.least(F.col("score") / F.col("_most"), F.lit(1.0))).otherwise(0.0)
    return scores.crossJoin(F.broadcast(most)).withColumn("score", value).drop("_most")


def lineage_patterns(terms: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, ancestor, dist, smarts): the patterns of each term and of all above it; terms (id, smarts) without one add none."""
    held = terms.filter("smarts is not null").select(F.col("id").alias("ancestor"), "smarts")
    return closed.join(held, "ancestor").select("term", "ancestor", "dist", "smarts")


def lineage(terms: DataFrame, closed: DataFrame) -> DataFrame:
    """(term, rank, ancestor, dist, smarts): ``lineage_patterns`` from the term itself up to the root, ranked from 1.

    Of terms (id, ord, smarts) at the same distance the one that comes first in the
    file (ord) leads, and then the smaller id. A term's lineage is a group of its own.
    """
    order = Window.partitionBy("term").orderBy("dist", "ord", "ancestor")
    held = lineage_patterns(terms, closed).join(terms.select(F.col("id").alias("ancestor"), "ord"), "ancestor")
    return held.select("term", F.row_number().over(order).alias("rank"), "ancestor", "dist", "smarts")
