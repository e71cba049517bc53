"""Operator 4: token-id files, frequency-ranked ids in byte-aligned variable-length coding.

write_ids() deals whole texts into ascending ranges of doc_id, encodes each range in its order and writes
it as blocks; a block has its own rank table, so any block can be read without the others and a lost task
redoes only its own range. Blocks are rows of a Parquet table (Spark's commit protocol and any file
system), their control and data bytes in separate columns. read_ids() decodes them.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; equal doc_ids each
keep a row of their own, next to each other; an empty table gives no rows; other columns are ignored.
A block closes once it holds BLOCK_IDS ids, so memory follows that and the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import id_codec
from tidemark.llm.common import sliced, text_or_empty
from tidemark.llm.tokens import encoder

BLOCK_IDS = 1 << 21

BLOCKS = "part int, part_start long, n_ids long, doc_ids binary, null_ids binary, counts binary, ranked binary, control binary, data binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str, parts: str, end_id: int) -> None:
    """Writes the ids of every text, each text followed by end_id, in ascending doc_id order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(vocabulary, parts).encode, TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            ids = np.concatenate([x for _, x in held])
            ranked, control, data = id_codec.encode(ids)
            names = [d for d, _ in held]
            row = {
                "part": pa.array([part], pa.int32()),
                "part_start": pa.array([done], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": [np.array([d or 0 for d in names], "<i8").tobytes()],
                "null_ids": [np.array([d is None for d in names]).tobytes()],
                "counts": [np.array([len(x) for _, x in held], "<u4").tobytes()],
                "ranked": [ranked],
                "control": [control],
                "data": [data],
            }
            done, size = done + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in sliced(batches, 512):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                held.append((doc_id, np.append(ids, np.array([end_id], ids.dtype))))
                size += len(ids) + 1
                if size >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    # The row number keeps the copies of one doc_id from having to share a range.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    rows.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, schema: str | None = None, emit: Callable | None = None) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), ids.

    With emit, what emit(doc_ids, starts, list of id arrays) returns for each block, a dict of columns of schema.
    """
    schema = schema or "doc_id long, start long, ids array<int>"
    emit = emit or (lambda doc_ids, starts, ids: {"doc_id": doc_ids, "start": pa.array(starts, pa.int64()), "ids": pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))})
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # A row for each range that was written: as many as shuffle partitions, however large the data.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for b in batch.to_pylist():
                ids = id_codec.decode(b["ranked"], b["control"], b["data"], b["n_ids"])
                ends = np.cumsum(np.frombuffer(b["counts"], "<u4").astype(np.int64))
                starts = np.concatenate([[0], ends[:-1]])
                doc_ids = pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=np.frombuffer(b["null_ids"], bool))
                cut = [ids[s:e] for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict(emit(doc_ids, starts + b["before"] + b["part_start"], cut))

    placed = blocks.join(F.broadcast(offsets), "part")
    return placed.select("before", "part_start", "n_ids", "doc_ids", "null_ids", "counts", "ranked", "control", "data").mapInArrow(documents, schema)


def crc32_of(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def digests(doc_ids: pa.Array, starts: np.ndarray, ids: list[np.ndarray]) -> dict:
    return {
        "doc_id": doc_ids,
        "start": pa.array(starts, pa.int64()),
        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "ids_crc32": pa.array([crc32_of(x) for x in ids], pa.int64()),
    }
