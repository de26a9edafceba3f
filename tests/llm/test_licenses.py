"""Operator 1: quotations with a word more, and stray hits at every distance before them."""

from strandlake.llm import licenses
from tests.llm.corpus import words

QUOTED = "this work is licensed under a very creative commons attribution 4 0 international license"


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (set(r["labels"]), r["score"]) for r in licenses.scan(docs).collect()}


def test_a_stray_hit_takes_no_label_away(spark):
    texts = [QUOTED, *(f"this work {'x ' * n}{QUOTED}" for n in range(40)), *(f"{QUOTED} {'x ' * n}international license" for n in range(20)), f"commons attribution {QUOTED} licensed under"]
    found = labels(spark, texts)
    for i, text in enumerate(texts):
        assert "cc-by" in found[i][0], text
        assert found[i][1] >= found[0][1] > 0.9


def test_windows_are_those_of_loops(spark):
    """Labels by the best window of four diagonals, in plain loops."""
    texts = [QUOTED, "this work is under a creative commons license", "licensed under cc by 4 0 and then licensed under the cc by sa 4 0", "released x under the mit license", "all rights reserved no part of part of this publication may be reproduced", "x"]
    found = labels(spark, texts)
    for i, text in enumerate(texts):
        w, want = words(text), set()
        for t in licenses.TEMPLATES:
            tw = words(t.text)
            hits = {(p - a, a) for p in range(len(w) - 1) for a in range(len(tw) - 1) if w[p : p + 2] == tw[a : a + 2]}
            if t.exact:
                if any(w[p : p + len(tw)] == tw for p in range(len(w))):
                    want.add(t.label)
                continue
            for d in {x for x, _ in hits}:
                held = {(x, a) for x, a in hits if d <= x <= d + licenses.NEIGHBOUR}
                first, end = min(x + a for x, a in held), max(x + a for x, a in held) + 2
                if len({a for _, a in held}) >= licenses.COVERAGE * (len(tw) - 1) and end - first <= 2 * len(tw):
                    want.add(t.label)
        assert found[i][0] == want, text
