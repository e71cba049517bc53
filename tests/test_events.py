from datetime import datetime, timedelta

from tidemark.plans import fixtures as fx
from tidemark.streaming import events


def log(spark, rows):
    return spark.createDataFrame([(r, s, datetime(2025, 1, 1) + timedelta(seconds=s), "detect", "info", t, "", "{}") for r, s, t in rows], events.SCHEMA)


def test_stream_gives_each_event_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    events.append(log(spark, [("a", 1, "x"), ("a", 2, "y")]), source)
    events.copy_new(spark, source, target, state)
    events.append(log(spark, [("a", 2, "y"), ("a", 3, "z"), ("b", 1, "w")]), source)  # a client sends one again
    events.copy_new(spark, source, target, state)
    got = sorted((r["run_id"], r["seq"]) for r in spark.read.parquet(target).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert [r["seq"] for r in events.replay(spark.read.parquet(source), "a", after=1).collect()] == [2, 3]


def test_stages_come_from_artifacts(spark):
    got = {r["run_id"]: r["stages"] for r in events.completed_stages(fx.local(spark, fx.RUNS, fx.RUN_SCHEMA)).collect()}
    assert got["r0"] == [] and got["r1"] == ["detect"]
    assert got["r2"] == ["detect", "impact", "codegen", "validate", "pr", "writeback"]
    assert got["r4"] == ["detect", "impact", "codegen"]
    assert got["r5"][-1] == "pr"


def test_phases(spark):
    from pyspark.sql import functions as F

    tools = ["detect_drift", "search_x", "generate", "drop_col", "validate_all", "open_pr", "write_tags", "other"]
    got = fx.local(spark, [(i, t) for i, t in enumerate(tools)], "i int, t string").orderBy("i").select(events.phase_of(F.col("t"))).collect()
    assert [r[0] for r in got] == ["detect", "impact", "codegen", "codegen", "validate", "pr", "writeback", "impact"]


def test_saved_runs_skip_what_cannot_be_read(spark, tmp_path):
    from tidemark.streaming import events

    (tmp_path / "runs.json").write_text('{"run_id": "a", "started_at": 2}\n{"run_id": "b", "started_at": 3}\nnot json\n')
    good, bad = events.load_runs(spark, str(tmp_path / "runs.json"), "run_id string, started_at long")
    assert [r["run_id"] for r in events.newest_first(good).collect()] == ["b", "a"]
    assert [r["line"] for r in bad.collect()] == ["not json"]
