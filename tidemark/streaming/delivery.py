"""Delivery of run events in order, each once, from a log that is neither ordered nor free of repetitions.

The log is a stream. Keyed state holds, for each run, the number delivered last and the events that came too
early; an event is delivered when all before it are, and one that was delivered or is held already is left out. A
consumer that comes back says what it has (the state begins there) and gets what follows. A gap that stays open
for longer than the patience is given up by a timer: what is held goes on behind it, and the first event says how
many are missing. Events that come later for a gap given up are left out, as for numbers delivered.

Held events lie in the state store by ranges of RANGE numbers, so a run may hold many and costs a few calls to the
store a micro-batch, not a few an event; only the rows at hand and one range are in memory. With the file sink and a checkpoint each event is written once, also after failures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.events import SCHEMA

PATIENCE = "1 hour"
#: Numbers of a run whose held events are one value of the state. Any size gives the same rows.
RANGE = 256
OUT = "run_id string, seq long, position long, skipped long, event string"
STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Settings of a delivery: keys' maps need this state store; and with timers of the clock, batches without data would follow each other for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class InOrder(StatefulProcessor):
    """sent: the number delivered last, how many were delivered, how many are held, until when a gap is waited for and when the timer rings (0: not)."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "seq long, position long, held long, due long, rings long")
        self.held = handle.getMapState("held", "range long", "seqs array<long>, events array<string>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.sent.update((int(initialState["after"].max()), 0, 0, 0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, position, held, due, rings = self.sent.get() or (0, 0, 0, 0, 0)
        before = seq
        for part in rows:
            fresh: dict[int, dict[int, str]] = {}
            for n, event in zip(part["seq"].tolist(), part["event"].tolist()):
                if n > seq:
                    fresh.setdefault(n // RANGE, {}).setdefault(n, event)
            found, seq, position, held = self.advance(key, fresh, seq, position, held)
            if len(found):
                yield found
        due, rings = self.timed(held, due, rings, seq != before, timerValues)
        self.sent.update((seq, position, held, due, rings))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, position, held, due, _ = self.sent.get()
        moved = False
        if held and due <= timerValues.getCurrentProcessingTimeInMs():
            first = min(self.kept(min(r for (r,) in self.held.keys())))
            found, after, position, held = self.advance(key, {}, first - 1, position, held)
            found.loc[0, "skipped"] = first - 1 - seq
            seq, moved = after, True
            yield found
        self.sent.update((seq, position, held, *self.timed(held, due, 0, moved, timerValues)))

    def kept(self, number: int) -> dict[int, str]:
        """The events held of a range."""
        found = self.held.getValue((number,))
        return dict(zip(*found)) if found else {}

    def keep(self, number: int, events: dict[int, str]) -> None:
        if events:
            self.held.updateValue((number,), (list(events), list(events.values())))
        else:
            self.held.removeKey((number,))

    def advance(self, key, fresh: dict[int, dict[int, str]], seq: int, position: int, held: int) -> tuple[pd.DataFrame, int, int, int]:
        """What can be delivered now, of fresh events (by range) and held ones; what can't is held, the event that came first."""
        begun, out = position, {"seq": [], "event": []}
        while True:
            number = (seq + 1) // RANGE
            kept = self.kept(number) if held else {}
            events = {**fresh.pop(number, {}), **kept}
            while (event := events.pop(seq + 1, None)) is not None:
                seq, position = seq + 1, position + 1
                out["seq"].append(seq)
                out["event"].append(event)
            held += len(events) - len(kept)
            if events.keys() != kept.keys():
                self.keep(number, events)
            if (seq + 1) // RANGE == number:
                break
        for number, events in fresh.items():
            kept = self.kept(number) if held else {}
            if events.keys() - kept.keys():
                events = {**events, **kept}
                self.keep(number, events)
                held += len(events) - len(kept)
        n = len(out["seq"])
        found = {"run_id": np.full(n, key[0], object), "seq": np.array(out["seq"], "int64"), "position": np.arange(begun + 1, position + 1), "skipped": np.zeros(n, "int64"), "event": np.array(out["event"], object)}
        return pd.DataFrame(found, copy=False), seq, position, held

    def timed(self, held: int, due: int, rings: int, moved: bool, timers) -> tuple[int, int]:
        """Until when the gap before what is held is waited for, and the timer that rings then or before; one that has only opened gets the whole patience.

        A timer that rings too early is set again, so a gap that moves each micro-batch needs no new one each time.
        """
        if not held:
            return 0, rings
        if moved or not due:
            due = timers.getCurrentProcessingTimeInMs() + self.patience
        if not rings:
            rings = due
            self.handle.registerTimer(rings)
        return due, rings

    def close(self) -> None:
        pass


def milliseconds(spark: SparkSession, span: str) -> int:
    return spark.sql(f"select unix_millis(timestamp_millis(0) + interval {span})").first()[0]


def in_order(log: DataFrame, patience: str = PATIENCE, after: DataFrame | None = None) -> DataFrame:
    """The events of a streamed log with position (how many its run has had) and skipped (how many before it were given up).

    after: run_id and after, the number that a consumer has had; runs that it doesn't name begin at 1.
    """
    schema = log.select(*(c for c in log.columns if c not in ("run_id", "seq"))).schema
    event = F.to_json(F.struct(*schema.fieldNames()), STAMPS)
    packed = log.where("run_id is not null and seq is not null").select("run_id", "seq", event.alias("event")).groupBy("run_id")
    begin = None if after is None else after.select("run_id", F.col("after").cast("long").alias("after")).groupBy("run_id")
    found = packed.transformWithStateInPandas(InOrder(milliseconds(log.sparkSession, patience)), OUT, "append", "processingTime", begin)
    return found.select("run_id", "seq", "position", "skipped", F.from_json("event", schema, STAMPS).alias("e")).select("run_id", "seq", "position", "skipped", "e.*")


def deliver(spark: SparkSession, source: str, target: str, checkpoint: str, after: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Carries what has arrived in one log since the last call to another, in order and once; the other log.

    files: how many a micro-batch takes.
    """
    stream = spark.readStream.schema(SCHEMA).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(source)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = in_order(stream, after=after).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if error := query.exception():
        raise error
    return spark.read.schema(f"{SCHEMA}, position long, skipped long").parquet(target)
