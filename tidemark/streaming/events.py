"""Run events: an append-only, replayable log, and what is derived from it.

A run's events are numbered from 1. The stream reads the log as files arrive, and a consumer that starts
again gets each event once: events carry their number, and those seen are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SCHEMA = "run_id string, seq long, ts timestamp, phase string, level string, title string, detail string, data string"


def number(rows: DataFrame, start: int = 0) -> DataFrame:
    """Events of each run in order of time, numbered after start.

    Ranges of (run, time) spread a long run over tasks; a task's share of a run is numbered from how many events
    its shares before hold.
    """
    order = ("run_id", "ts", "title")
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    shares = placed.groupBy("run_id", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("run_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(F.col("run_id").alias("_run"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = placed.join(shares, placed["run_id"].eqNullSafe(shares["_run"]) & (placed["_part"] == shares["_p"]))
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1 + start).alias("seq"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def tail(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """The log as a stream, each (run_id, seq) once. State is kept for events up to `late` behind the newest."""
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def replay(log: DataFrame, run_id: str, after: int = 0) -> DataFrame:
    """A run's events past those a client has, in order; a repeated number keeps its first title."""
    rows = log.where((F.col("run_id") == run_id) & (F.col("seq") > after))
    return rows.groupBy("run_id", "seq").agg(*(F.min_by(c, F.struct("ts", "title")).alias(c) for c in rows.columns if c not in ("run_id", "seq"))).orderBy("seq")


def copy_new(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Carries what has arrived since the last call from one log to another."""
    query = tail(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if error := query.exception():
        raise error


def phase_of(tool: Column) -> Column:
    """The phase that a tool belongs to, by what its name holds; the first that fits."""
    # What marks the tools of a phase.
    phases = (("detect", "detect"), ("impact", "impact|lineage|schema|quer|search"), ("codegen", "generate|drop"), ("validate", "validate"), ("pr", "pull|pr"), ("writeback", "write|incident|tag"))
    found = F.when(F.lit(False), "")
    for phase, words in phases:
        found = found.when(tool.rlike(words), phase)
    return found.otherwise("impact")


def completed_stages(runs: DataFrame) -> DataFrame:
    """run_id, stages: judged by what each run produced.

    runs: run_id, has_drift, requires_patch (null without an impact report), patches, invalid_patches,
    review_ok, actions, failed_actions.
    """
    nothing = (F.col("patches") == 0) & (F.coalesce("requires_patch", F.lit(-1)) == 0)
    stages = (
        ("detect", F.col("has_drift")),
        ("impact", F.col("requires_patch").isNotNull()),
        ("codegen", (F.col("patches") > 0) | nothing),
        ("validate", nothing | ((F.col("patches") > 0) & (F.col("invalid_patches") == 0))),
        ("pr", nothing | F.coalesce("review_ok", F.lit(False))),
        ("writeback", (F.col("actions") > 0) & (F.col("failed_actions") == 0)),
    )
    return runs.select("run_id", F.array_compact(F.array(*(F.when(done, name) for name, done in stages))).alias("stages"))


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id")


def run_records(runs: DataFrame) -> DataFrame:
    """run_id, event, result: that a run started, and how it ended: FAILURE where a patch or an action failed.

    runs: as in completed_stages.
    """
    failed = (F.col("invalid_patches") > 0) | (F.col("failed_actions") > 0)
    both = F.array(F.struct(F.lit("STARTED").alias("event"), F.lit(None).cast("string").alias("result")), F.struct(F.lit("COMPLETE").alias("event"), F.when(failed, "FAILURE").otherwise("SUCCESS").alias("result")))
    return runs.select("run_id", F.explode(both).alias("e")).select("run_id", "e.*")


def load_runs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Saved runs (JSON lines) that can be read, and the lines that can't, which the caller may warn of."""
    rows = spark.read.schema(f"{schema}, _unreadable string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_unreadable").json(path)
    names = [c for c in rows.columns if c != "_unreadable"]
    bad = rows.withColumn("line", F.col("_unreadable")).where("_unreadable is not null")
    return rows.where("_unreadable is null").select(*names), bad.select(*names[:1], "line")
