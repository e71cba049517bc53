"""Delivery in order and once, over several calls, for clients that come back, and past events that never come."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tidemark.streaming import delivery, events


def log(spark, rows):
    return spark.createDataFrame([(r, s, datetime(2025, 1, 1, microsecond=s or 0) + timedelta(seconds=i), "detect", "info", t, "é", None) for i, (r, s, t) in enumerate(rows)], events.SCHEMA)


def rows(frame):
    return sorted((r["run_id"], r["position"], r["seq"], r["title"], r["skipped"]) for r in frame.collect())


def test_events_wait_for_those_before_them(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("log", "out", "state")]
    events.append(log(spark, [("a", 3, "c"), ("a", 1, "a"), ("a", 1, "a"), ("b", 2, "y"), (None, 1, "none"), ("c", None, "none")]), paths[0])
    assert rows(delivery.deliver(spark, *paths)) == [("a", 1, 1, "a", 0)]
    events.append(log(spark, [("a", 5, "e"), ("a", 3, "again"), ("b", 1, "x")]), paths[0])
    assert rows(delivery.deliver(spark, *paths)) == [("a", 1, 1, "a", 0), ("b", 1, 1, "x", 0), ("b", 2, 2, "y", 0)]
    events.append(log(spark, [("a", 4, "d"), ("a", 2, "b"), ("a", 1, "late"), ("b", 2, "late")]), paths[0])
    found = delivery.deliver(spark, *paths)
    assert rows(found) == [("a", i, i, t, 0) for i, t in enumerate("abcde", 1)] + [("b", 1, 1, "x", 0), ("b", 2, 2, "y", 0)]
    assert rows(delivery.deliver(spark, *paths)) == rows(found)
    first = found.where("run_id = 'a' and seq = 1").first()
    assert first["ts"] == datetime(2025, 1, 1, 0, 0, 1, 1) and first["detail"] == "é" and first["data"] is None


def test_a_client_that_comes_back_gets_what_follows(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("log", "out", "state")]
    events.append(log(spark, [(r, s, f"{r}{s}") for r in "ab" for s in (4, 2, 3, 1, 2)]), paths[0])
    after = spark.createDataFrame([("a", 2), ("z", 9)], "run_id string, after long")
    assert rows(delivery.deliver(spark, *paths, after=after, files=1)) == [("a", 1, 3, "a3", 0), ("a", 2, 4, "a4", 0)] + [("b", s, s, f"b{s}", 0) for s in (1, 2, 3, 4)]


def test_gaps_are_given_up_after_a_while(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    events.append(log(spark, [("a", 1, "a"), ("a", 4, "d"), ("a", 5, "e"), ("a", 8, "h")]), source)
    stream = spark.readStream.schema(events.SCHEMA).parquet(source)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, delivery.SETTINGS[key])
    try:
        query = delivery.in_order(stream, patience="3 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="500 milliseconds").start()
        want = [("a", 1, 1, "a", 0), ("a", 2, 4, "d", 2), ("a", 3, 5, "e", 0), ("a", 4, 8, "h", 2)]
        deadline, got = time.time() + 90, []
        while time.time() < deadline and got != want:
            time.sleep(1)
            try:
                got = rows(spark.read.schema(f"{events.SCHEMA}, position long, skipped long").parquet(out))
            except Exception:  # nothing is written yet
                got = []
    finally:
        query.stop()
        spark.conf.unset(key)
    assert got == want


def test_long_runs_are_numbered_over_ranges(spark):
    rows = [("long", i) for i in range(5000)] + [(f"r{i % 50}", i) for i in range(500)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame([(r, datetime(2025, 1, 1) + timedelta(seconds=(i * 7919) % 5003), f"{i:06}") for r, i in rows], "run_id string, ts timestamp, title string").repartition(7)
    got = {}
    for r in events.number(frame, start=10).collect():
        got.setdefault(r["run_id"], []).append((r["seq"], r["ts"], r["title"]))
    for run in got.values():
        run.sort()
        assert [s for s, _, _ in run] == list(range(11, 11 + len(run)))
        assert [x[1:] for x in run] == sorted(x[1:] for x in run)
    assert sum(map(len, got.values())) == len(rows)


class Kept:
    """A value or a map of the state store, and how often it was called."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None,
            "get": lambda: self.value,
            "update": lambda x: setattr(self, "value", x),
            "keys": lambda: iter(list(self.map)),
            "containsKey": lambda k: k in self.map,
            "getValue": self.map.get,
            "updateValue": self.map.__setitem__,
            "removeKey": lambda k: self.map.pop(k, None),
        }[name]


class Now:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1_000_000


class Timers:
    def __init__(self):
        self.calls = 0

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815


def test_waiting_events_cost_few_calls_a_batch():
    rnd = np.random.default_rng(2)
    process, order, got = delivery.InOrder(3_600_000), rnd.permutation(np.repeat(np.arange(1, 1001), 2)), []
    process.handle, process.sent, process.held = Timers(), Kept(), Kept()
    for batch in np.array_split(order, 8):
        part = pd.DataFrame({"seq": batch, "event": [f"e{n}" for n in batch]})
        for found in process.handleInputRows(("a",), iter([part.iloc[:100], part.iloc[100:]]), Now()):
            got += list(zip(found["seq"], found["position"], found["event"]))
    assert got == [(n, n, f"e{n}") for n in range(1, 1001)] and not process.held.map
    assert process.sent.calls + process.held.calls + process.handle.calls < 300
