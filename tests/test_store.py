"""Stored tables: change sets in any order and number, partitions that stay as they are, and a writer lost half way."""

import os
from itertools import permutations

import pytest

from tidemark.operators import store


def table(tmp_path, **options):
    return store.notes(str(tmp_path / "notes"), {"a": "string", "b": "long"}, parts=8, **options)


def changes(spark, rows):
    return spark.createDataFrame(rows, "dataset_urn string, name string, a string, b long, version long")


def records(spark, t):
    return sorted(map(tuple, store.read(spark, t).collect()), key=repr)


def files(t):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(t.path) for f in fs if f.endswith(".parquet")}


ONE = [("d", "x", "first", 1, 1), ("d", "y", None, 2, 1), ("d", "z", "stays", None, 1)]
TWO = [("d", "x", "second", None, 2), ("d", "y", "y2", None, 2), (None, "x", "no key", 1, 9), ("d", "x", "no version", 9, None)]
THREE = [("d", "x", "third", None, 3), ("d", "x", "tie", None, 3), ("e", "x", None, 7, 3)]
WANT = [("d", "x", "tie", 1), ("d", "y", "y2", 2), ("d", "z", "stays", None), ("e", "x", None, 7)]


@pytest.mark.parametrize("order", list(permutations(range(3)))[::2])
def test_any_order_of_change_sets_gives_one_state(spark, tmp_path, order):
    t = table(tmp_path)
    for i in order:
        store.merge(spark, t, changes(spark, (ONE, TWO, THREE)[i]))
    assert records(spark, t) == WANT
    before = files(t)
    assert store.merge(spark, t, changes(spark, ONE)) == [] and store.merge(spark, t, changes(spark, [])) == []
    assert records(spark, t) == WANT and files(t) == before  # nothing was written


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    t = table(tmp_path)
    store.merge(spark, t, changes(spark, [("d", str(i), "a", i, 1) for i in range(100)]))
    before = files(t)
    parts = store.merge(spark, t, changes(spark, [("d", "5", "b", None, 2), ("d", "6", "a", None, 1)]))
    after = files(t)
    assert len(parts) == 1
    for path in set(before) | set(after):
        assert (before.get(path) == after.get(path)) == (f"part={parts[0]}/" not in path)
    assert len(records(spark, t)) == 100


def test_a_lost_writer_loses_no_records(spark, tmp_path, monkeypatch):
    t = table(tmp_path)
    store.merge(spark, t, changes(spark, ONE))

    def dies(spark, table, parts):
        """Partitions are gone, and nothing is in their place."""
        for p in parts:
            os.rename(f"{table.path}/part={p}", str(tmp_path / f"gone-{p}"))
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "exchange", dies)
        with pytest.raises(RuntimeError):
            store.merge(spark, t, changes(spark, TWO))
    assert len(records(spark, t)) < 3
    store.merge(spark, t, changes(spark, []))
    assert ("d", "y", "y2", 2) in records(spark, t) and len(records(spark, t)) == 3


def test_the_first_label_stays(spark, tmp_path):
    t = store.links(str(tmp_path / "links"))
    rows = lambda *r: spark.createDataFrame(list(r), "urn string, url string, label string, version long")
    store.merge(spark, t, rows(("u", "http://a", "later", 5), ("u", "http://a", "tie z", 3), ("u", "http://a", "tie a", 3)))
    store.merge(spark, t, rows(("u", "http://a", "earliest", 1), ("u", "http://b", None, 1)))
    assert records(spark, t) == [("u", "http://a", "earliest"), ("u", "http://b", None)]


def test_edges_are_replaced_by_the_dataset_they_lead_into(spark, tmp_path):
    t = store.edges(str(tmp_path / "edges"), parts=4)
    rows = lambda *r: spark.createDataFrame([(*x, 1) for x in r], "up_urn string, up_path string, down_urn string, down_path string, operation string, version long")
    groups = lambda *g: spark.createDataFrame([(x,) for x in g], "down_urn string")
    store.merge(spark, t, rows(("a", "1", "x", "1", "SUM"), ("a", "2", "x", "2", "SUM"), ("a", "1", "y", "1", "MIN")))
    for _ in range(2):
        store.replace(spark, t, groups("x"), rows(("a", "9", "x", "1", "COUNT"), ("a", "9", "y", "9", "ignored")))
        assert records(spark, t) == [("a", "1", "y", "1", "MIN"), ("a", "9", "x", "1", "COUNT")]
    store.replace(spark, t, groups("x", "none"), rows())
    store.replace(spark, t, groups(), rows())
    store.merge(spark, t, rows())
    assert records(spark, t) == [("a", "1", "y", "1", "MIN")]
    store.replace(spark, t, groups("y"), rows())
    assert records(spark, t) == []
