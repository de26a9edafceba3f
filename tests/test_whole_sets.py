"""Averages and pairs of described sets against brute force, and what their plans send."""

import math
import random

import pytest

from strandlake.operators import ontology


@pytest.fixture(scope="module")
def made(spark):
    """A random ontology of 40 terms, sets of 30 entities, repeats among them, and what is expected of each two terms."""
    rng = random.Random(7)
    names = [f"t{i:02}" for i in range(40)]
    links = [(names[i], p) for i in range(1, 40) for p in {names[rng.randrange(i)] for _ in range(2)}]
    up = {}
    for name in names:
        up[name] = {name}.union(*(up[p] for c, p in links if c == name))
    ic = {n: round(rng.random() * 5, 3) if rng.random() < 0.8 else 0.0 for n in names}
    sets = {e: {rng.choice([*names, "outside"]) for _ in range(rng.randrange(1, 6))} for e in range(30)}
    compared = sorted({(rng.randrange(32), rng.randrange(32)) for _ in range(60)})  # 30 and 31 have no terms
    up["outside"], ic["outside"] = set(), 2.5
    resnik = lambda x, y: ic[x] if x == y else max((ic[a] for a in up[x] & up[y]), default=0.0)
    lin = lambda x, y: min(2 * resnik(x, y) / (ic[x] + ic[y]), 1.0) if ic[x] + ic[y] > 0 else 0.0
    frames = (
        spark.createDataFrame([(e, t) for e, ts in sets.items() for t in [*ts, *ts]], "entity long, term string"),
        spark.createDataFrame(compared, "a long, b long"),
        ontology.closure(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(links, "child string, parent string")),
        spark.createDataFrame(list(ic.items()), "term string, ic double"),
    )
    return ontology.beside(*frames), sets, compared, resnik, lin


def test_best_matches_and_coverage(made):
    met, sets, compared, resnik, lin = made
    mean = lambda xs: math.fsum(xs) / len(xs) if xs else 0.0
    of = lambda e: sets.get(e, set())
    one = lambda a, b, value: [max(value(x, y) for y in of(b)) for x in of(a)] if of(a) and of(b) else []
    for value, given in ((ontology.resnik_of, resnik), (ontology.lin_of, lin)):
        got = {(r["a"], r["b"]): r["score"] for r in ontology.best_matches(met, value).collect()}
        assert got == {(a, b): pytest.approx(mean(one(a, b, given) + one(b, a, given)), abs=1e-9) for a, b in compared}
    got = {(r["a"], r["b"]): r["score"] for r in ontology.covered(met).collect()}
    assert got == {(a, b): pytest.approx(mean(one(a, b, lin)), abs=1e-9) for a, b in compared}


@pytest.mark.parametrize("rows", [10, 5_000_000])
def test_lin_of_each_two_terms_both_ways(made, rows):
    met, sets, compared, _, lin = made
    there = {(x, y) for a, b in compared for x in sets.get(a, ()) for y in sets.get(b, ())}
    got = [(r["t1"], r["t2"], r["lin"]) for r in ontology.lin_both_ways(met, rows).collect()]
    assert len(got) == len({x[:2] for x in got})
    assert {x[:2]: x[2] for x in got} == {p: pytest.approx(lin(*p)) for x, y in there for p in ((x, y), (y, x))}


def test_pairs_of_terms_do_not_travel_for_averages(spark):
    """One row for each two entities is dealt out, and nothing by two terms."""
    from strandlake.plans import catalogue

    for name in ("semantic_bma", "resnik_bma", "coverage", "lin_pairs"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "hashpartitioning(t1#" not in plan and "hashpartitioning(t2#" not in plan and plan.count("hashpartitioning(low#") == (name == "lin_pairs") * plan.count("REPARTITION_BY_NUM"), name
