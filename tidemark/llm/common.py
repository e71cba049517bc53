"""Helpers that the operators share: tables, staged results, the documents' words and folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six white space characters of ASCII; words are the runs between them.
WORD_BREAKS = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions that name none, by application.
LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir. Where that is unset, a session of a local master gets a
    temporary folder of its own; on a cluster it is an error. What is staged there stays until the folder's
    owner clears it, as results are read from it lazily.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in LOCAL_DIRS:
        LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and it is computed once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def carried(docs: DataFrame, carry: Sequence[str]) -> list[Column]:
    """The columns of carry as one struct, in which no name clashes with a result's; nothing if carry is empty."""
    return [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []


def with_carried(rows: DataFrame, schema: str) -> T.StructType:
    """schema, and after it rows' struct of carried columns, if it has one."""
    return T.StructType([*T.StructType.fromDDL(schema).fields, *(f for f in rows.schema if f.name == "carried")])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that the Python objects made of one don't add up over a whole batch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def carried_of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return {"carried": batch.column("carried")} if "carried" in batch.schema.names else {}


def thinned(rows: DataFrame, by: str, sizes: dict, hashed: Column, keep: int) -> DataFrame:
    """Of each group of by, about twice keep rows (all, if there are fewer): those of the smallest hashes.

    Ranking what is left moves a bounded number of rows, however many the group has.
    """
    parts = 1 << 20
    shares = {group: parts if size <= 2 * keep else max(1, -(-2 * keep * parts // size)) for group, size in sizes.items()}
    if not shares:
        return rows.where(F.lit(False))
    by_group = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))  # flat, however many groups there are
    return rows.where(F.pmod(hashed, F.lit(parts)) < F.coalesce(F.try_element_at(by_group, F.col(by)), F.lit(0)))
