"""Similarity candidates against all pairs, and greedy matching in rounds against taking pairs in turn."""

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from tidemark.operators import drift, matching
from tidemark.plans import tables


def ratio(a, b):
    return SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


def named(spark, rows):
    return spark.createDataFrame(rows, "g string, name string")


def every_pair(old, new, least):
    return {(g, a, b): ratio(a, b) for g, a in set(old) for h, b in set(new) if g == h and None not in (a, b) and ratio(a, b) >= least}


@pytest.mark.parametrize("least", [(11, 20), (4, 5), (1, 10), (1, 1)])
def test_alike_loses_no_pair(spark, least):
    rnd = np.random.default_rng(1)
    word = lambda: "".join(rnd.choice(list("abcdeABéß_𝒳"), rnd.integers(1, 9)))
    old = [(str(i % 2), word()) for i in range(60)] + [("0", ""), ("0", "same"), ("0", "same"), (None, "x"), ("1", None)]
    new = [(str(i % 2), word()) for i in range(60)] + [("0", ""), ("0", "SAME"), ("2", "alone"), ("1", None)]
    got = {(r["g"], r["old"], r["new"]): r["similarity"] for r in matching.alike(named(spark, old), named(spark, new), ["g"], least).collect()}
    assert got == every_pair([x for x in old if x[0]], new, least[0] / least[1])


def test_only_pairs_within_the_bound_are_compared(spark):
    old, new = [("g", f"customer_{i}") for i in range(30)], [("g", f"qqxxwwzz{i}") for i in range(30)] + [("g", "customer_key")]
    got = {(r["old"], r["new"]) for r in matching.candidates(named(spark, old), named(spark, new), ["g"], (11, 20)).collect()}
    bound = lambda a, b: 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))
    assert got == {(a, b) for _, a in old for _, b in new if bound(a, b) >= 0.55} and len(got) == 30


def in_turn(pairs):
    """pairs: group, left, right, rank."""
    left, right, out = set(), set(), []
    for g, a, b, r in sorted(pairs, key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if (g, a) not in left and (g, b) not in right:
            out.append((g, a, b, r))
            left.add((g, a))
            right.add((g, b))
    return sorted(out)


@pytest.mark.parametrize("ranks", [3, 1000])
def test_rounds_take_the_pairs_that_turns_take(spark, ranks):
    rnd = np.random.default_rng(ranks)
    pairs = {(int(g), int(a), int(b)): int(r) for g, a, b, r in zip(rnd.integers(3, size=900), rnd.integers(25, size=900), rnd.integers(25, size=900), rnd.integers(ranks, size=900))}
    rows = [(*k, r) for k, r in pairs.items()]
    rows += [(9, 0, b, b) for b in range(300)] + [(9, a, 0, a) for a in range(300)]  # a hot end on either side
    got = matching.greedy(spark.createDataFrame(rows, "g long, a long, b long, r long"), ["g", "a"], ["g", "b"], ["r", "a", "b"])
    assert sorted(map(tuple, got.collect())) == in_turn(rows)


def test_greedy_of_nothing(spark):
    assert matching.greedy(spark.createDataFrame([], "g long, a long, b long, r long"), ["g", "a"], ["g", "b"], ["r"]).collect() == []


def test_descending_chain_takes_every_other_pair(spark):
    rows = [(0, i // 2, (i + 1) // 2, 100 - i) for i in range(24)]
    got = matching.greedy(spark.createDataFrame(rows, "g long, a long, b long, r long"), ["g", "a"], ["g", "b"], ["r"])
    assert sorted(map(tuple, got.collect())) == in_turn(rows) and len(in_turn(rows)) == 12


def test_renamed_parts_by_brute_force(spark, small):
    columns = [{(r["dataset_urn"], r["name"]): r for r in tables.part_columns(spark, small, odd).collect()} for odd in (0, 1)]
    pairs = []
    for (g, a), x in columns[0].items():
        for (h, b), y in columns[1].items():
            if g == h and (g, a) not in columns[1] and (g, b) not in columns[0] and ratio(a, b) >= drift.THRESHOLD:
                pairs.append((g, a, b, (x["native_type"] == y["native_type"], ratio(a, b), x["ordinal"] == y["ordinal"])))
    want = [(g, a, b, min(0.9, 0.5 * r[0] + 0.4 * r[1] + 0.1 * r[2])) for g, a, b, r in in_turn(pairs)]
    got = sorted((r["dataset_urn"], r["old_column"], r["new_column"], r["confidence"]) for r in tables.renamed_parts(spark, small).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want]) and len(got) > 10


def placed(spark, rows):
    return spark.createDataFrame(rows, "g long, key long, at long")


@pytest.mark.parametrize("spread, width", [(12, 3), (60, 8), (4000, 200), (1, 0)])
def test_nearest_takes_what_turns_take(spark, spread, width):
    rnd = np.random.default_rng(spread)
    one, two = ([(g, i, int(rnd.integers(-spread, spread))) for g in range(3) for i in range(n)] for n in (70, 45))
    pairs = [(g, a, b, (-abs(x - y), -a, -b)) for g, a, x in one for h, b, y in two if g == h and abs(x - y) <= width]
    want = sorted((g, a, b, -r[0]) for g, a, b, r in nearest_in_turn(pairs))
    odd = [(None, 1, 0), (0, None, 0), (0, 999, None)]
    got = matching.nearest(placed(spark, one + odd), placed(spark, two + odd), ["g"], width)
    assert sorted(map(tuple, got.select("g", "left", "right", "apart").collect())) == want and want


def nearest_in_turn(pairs):
    left, right, out = set(), set(), []
    for g, a, b, r in sorted(pairs, key=lambda p: p[3], reverse=True):
        if (g, a) not in left and (g, b) not in right:
            out.append((g, a, b, r))
            left.add((g, a))
            right.add((g, b))
    return out


def test_nearest_lists_no_pairs_and_takes_equal_places_at_once(spark, monkeypatch):
    rows, write = [], matching.written

    def counted(df, name):
        out = write(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(matching, "written", counted)
    one, two = ([(0, i, 10 * s + 100 * (i % 3)) for i in range(n)] for s, n in ((0, 600), (1, 500)))
    got = matching.nearest(placed(spark, one), placed(spark, two), ["g"], 1000).collect()
    assert len(got) == 500 and max(n for _, n in rows) <= 1100  # all pairs are 300,000
    assert sum(name == "taken" for name, _ in rows) <= 4
