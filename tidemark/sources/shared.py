"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that name none, by application.
LOCAL_DIRS: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a local master gets a temporary folder, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in LOCAL_DIRS:
            LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        folder = LOCAL_DIRS[context.applicationId]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How many rows of a query's largest table a task of a shuffle gets, about.
ROWS = 250_000


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles that run inside have so many tasks that what one sorts stays the same however many rows there are; never fewer than the session's.

    Only what is written inside is run so; a lazy result is run later, with the session's own settings.
    """
    tasks, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k, None) for k in (tasks, joined)}
    least = int(before[tasks] or 200)
    if rows <= ROWS * least:
        yield
        return
    try:
        spark.conf.set(tasks, -(-rows // ROWS))
        spark.conf.set(joined, "false")  # what compresses well would come together again, by its bytes
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
