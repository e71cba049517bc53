"""A closure kept up to date against one computed anew."""

import numpy as np
import pytest

from tidemark.operators import closure, lineage

EDGE = "up_urn string, up_path string, down_urn string, down_path string, operation string"


def frame(spark, pairs):
    return spark.createDataFrame([("D", f"C{a}", "d", f"c{b}", "SUM") for a, b in pairs], EDGE)


def begin_of(spark, *starts):
    return spark.createDataFrame([(f"from {s}", "d", f"c{s}") for s in starts], "drift string, urn string, path string")


def reached(rows):
    return sorted((r["drift"], r["path"].lower()) for r in rows.collect())


def updated(spark, old, lost, gained, starts):
    begin, edges = begin_of(spark, *starts), frame(spark, old)
    return closure.maintained(lineage.closure(edges, begin), begin, edges, frame(spark, lost), frame(spark, gained))


@pytest.mark.parametrize("seed", range(4))
def test_same_as_computed_anew(spark, seed):
    rnd = np.random.default_rng(seed)
    old = {tuple(map(int, e)) for e in rnd.integers(0, 30, (45, 2))}
    lost = {e for e in old if rnd.random() < 0.3}
    gained = {tuple(map(int, e)) for e in rnd.integers(0, 34, (6, 2))}
    got, touched = updated(spark, old, lost, gained, (0, 1, 2))
    now = (old - lost) | gained
    assert reached(got) == reached(lineage.closure(frame(spark, now), begin_of(spark, 0, 1, 2)))
    before, after = set(reached(lineage.closure(frame(spark, old), begin_of(spark, 0, 1, 2)))), set(reached(got))
    by = {s: set(reached(touched.where(f"became = '{s}'"))) for s in ("gone", "again", "new")}
    assert by["gone"] == before - after and by["new"] >= after - before and by["again"] <= before & after


def test_a_cycle_does_not_keep_itself_alive(spark):
    got, touched = updated(spark, [(0, 1), (1, 2), (2, 3), (3, 1), (0, 4)], [(0, 1)], [], [0])
    assert reached(got) == [("from 0", "c4")]
    assert {r["became"] for r in touched.collect()} == {"gone"}


def test_little_is_touched(spark):
    chain = [(i, i + 1) for i in range(20)] + [(0, 100)] + [(100, 200 + i) for i in range(200)]
    got, touched = updated(spark, chain, [(18, 19)], [(19, 1300), (5, 1301)], [0])
    assert reached(touched) == [("from 0", "c1301"), ("from 0", "c19"), ("from 0", "c20")]
    assert ("from 0", "c200") in reached(got) and ("from 0", "c1300") not in reached(got)


def test_nothing_changes(spark):
    got, touched = updated(spark, [(0, 1), (1, 2)], [], [], [0])
    assert reached(got) == [("from 0", "c1"), ("from 0", "c2")] and touched.count() == 0
