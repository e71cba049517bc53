"""Scopes against a stack and against all intervals tried."""

import numpy as np

from tidemark.operators import nesting


def stack_pairs(marks):
    stack, found = [], []
    for at, step in sorted(marks):
        if step > 0:
            stack.append(at)
        elif stack:
            found.append((stack.pop(), at))
    return sorted(found)


def test_pairs_as_a_stack_makes_them(spark):
    rnd = np.random.default_rng(2)
    texts = {t: [(int(a), int(rnd.choice([1, -1]))) for a in rnd.permutation(60)[: rnd.integers(0, 40)]] for t in range(80)}
    frame = spark.createDataFrame([(t, a, s) for t, m in texts.items() for a, s in m] + [(1, None, 1)], "text int, at int, step int")
    got = {}
    for r in nesting.pairs(frame.union(frame), ["text"]).collect():
        got.setdefault(r["text"], []).append((r["begin"], r["end"]))
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, m in texts.items() if (v := stack_pairs(m))}


def crosses(a, b):
    return a[0] < b[0] < a[1] < b[1] or b[0] < a[0] < b[1] < a[1]


def test_what_nests_and_what_encloses(spark):
    rnd = np.random.default_rng(3)
    texts = {}
    for t in range(60):
        places = [int(p) for p in rnd.permutation(80)[: 2 * rnd.integers(1, 9)]]
        texts[t] = [tuple(sorted(places[i : i + 2])) for i in range(0, len(places), 2)]
    frame = spark.createDataFrame([(t, *i) for t, v in texts.items() for i in v], "text int, begin int, end int")
    kept, crossed = nesting.nested(frame, ["text"])
    left = {t: [] for t in texts}
    for r in kept.collect():
        left[r["text"]].append((r["begin"], r["end"], r["level"]))
    assert sum(map(len, left.values())) + crossed.count() == frame.count()
    assert crossed.count() > 0
    for t, v in left.items():
        assert not any(crosses(a, b) for a in v for b in v)
        # What crosses nothing stays.
        assert {i for i in texts[t] if not any(crosses(i, j) for j in texts[t])} <= {i[:2] for i in v}
        for b, e, level in v:
            assert level == sum(x <= b and e <= y for x, y, _ in v)
    points = spark.createDataFrame([(t, p, f"p{p}") for t in texts for p in range(-1, 82) for _ in range(1 + (p == 7))] + [(999, 1, "none")], "text int, at int, label string")
    found = nesting.enclosing(points, kept, ["text"]).collect()
    assert len(found) == points.count()
    for r in found:
        around = [i[:2] for i in left.get(r["text"], []) if i[0] < r["at"] < i[1]]
        assert (r["begin"], r["end"]) == (max(around) if around else (None, None)) and r["label"] in (f"p{r['at']}", "none")


def test_properly_nested_needs_one_round(spark):
    kept, crossed = nesting.nested(spark.createDataFrame([(1, 0, 9), (1, 1, 4), (1, 5, 8), (1, 2, 3)], "text int, begin int, end int"), ["text"])
    assert crossed.count() == 0 and sorted(r["level"] for r in kept.collect()) == [1, 2, 2, 3]


def test_nothing_to_nest(spark):
    none = spark.createDataFrame([], "text int, begin int, end int")
    assert nesting.nested(none, ["text"])[0].count() == 0
    points = spark.createDataFrame([(1, 5)], "text int, at int")
    assert [tuple(r) for r in nesting.enclosing(points, none, ["text"]).collect()] == [(1, 5, None, None)]
