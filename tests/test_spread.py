"""Shuffles with as many tasks as rows ask for, and searches without paths against those with them."""

import pytest

from tidemark.operators import lineage, store
from tidemark.sources import shared

EDGE = "up_urn string, up_path string, down_urn string, down_path string, operation string"
TASKS, JOINED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def test_tasks_follow_rows_and_settings_come_back(spark):
    before = spark.conf.get(TASKS), spark.conf.get(JOINED)
    with pytest.raises(ZeroDivisionError), shared.spread(spark, 10 * shared.ROWS):
        assert spark.conf.get(TASKS) == "10"
        raise ZeroDivisionError
    assert (spark.conf.get(TASKS), spark.conf.get(JOINED)) == before
    with shared.spread(spark, 5):
        assert (spark.conf.get(TASKS), spark.conf.get(JOINED)) == before


def test_staged_and_pathless_searches_find_the_same(spark):
    pairs = [(a, (a * 7 + i) % 40) for a in range(40) for i in (1, 5, 11)]
    edges = spark.createDataFrame([(f"d{a % 9}", f"c{a}", f"d{b % 9}", f"c{b}", "SUM") for a, b in pairs], EDGE)
    begin = lineage.starts(spark, [("one", "d1", "c1"), ("two", "d2", "c2"), ("none", "d0", "x")])
    rows = lambda f: sorted(map(str, f.collect()))
    for hops in (1, 2, 3):
        plain = lineage.column_impact(edges, begin, hops)
        assert rows(lineage.column_impact(edges, begin, hops, staged=True)) == rows(plain)
        assert rows(lineage.reached(edges, begin, hops)) == rows(plain.select("drift", "urn")) != []
        assert rows(lineage.shortest_paths(edges, begin, hops, staged=True)) == rows(lineage.shortest_paths(edges, begin, hops))


def test_a_table_partition_is_written_by_several_tasks_if_shuffles_have_many(spark, tmp_path):
    table = store.tags(str(tmp_path / "tags"), parts=1)
    rows = spark.range(500).selectExpr("cast(id as string) as urn", "'f' as field", "'t' as tag", "1L as version")
    with shared.spread(spark, 12 * shared.ROWS):
        store.merge(spark, table, rows)
    assert len(store.stored(spark, table).inputFiles()) > 1
    assert sorted(int(r["urn"]) for r in store.read(spark, table).collect()) == list(range(500))
