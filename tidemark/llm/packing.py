"""Operator 6: best-fit decreasing packing of documents into training sequences.

pieces() cuts each document's ids into full windows and a rest; pack() places pieces. Pieces are dealt
over groups of about GROUP by their row number, so that no document or source makes a group large, and
each group is packed on its own: longest piece first, into the open window with the least room that still
holds it, which a segment tree indexed by remaining room finds; otherwise into a new window. A group
leaves a few windows unfilled; that is all the padding that grouping adds.

Defined results: a null or empty text is the end id alone; equal documents each keep their pieces; an
empty table gives no rows; very long texts are many full windows and a rest. pack() keeps all columns of
its pieces, of whatever names, but for sequence_id and offset, which its results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import sliced, staged, text_or_empty
from tidemark.llm.id_files import crc32_of
from tidemark.llm.tokens import encoder

GROUP = 8192


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths are in descending order, from 1 to capacity."""
    leaves = 1 << capacity.bit_length()
    open_windows = [0] * (2 * leaves)  # node 1 is the root, leaf leaves + r counts windows with r left
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []

    def count(room: int, by: int) -> None:
        node = leaves + room
        while node:
            open_windows[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """The least room of at least need that an open window has, or -1."""
        node = leaves + need
        if open_windows[node]:
            return need
        while node > 1:
            if not node & 1 and open_windows[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < leaves:
            node = 2 * node if open_windows[2 * node] else 2 * node + 1
        return node - leaves

    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        room = tightest(length)
        if room < 0:
            window, room = len(used), capacity
            used.append(0)
        else:
            window = by_room[room].pop()
            count(room, -1)
        windows[i], offsets[i] = window, used[window]
        used[window] += length
        if room > length:
            by_room[room - length].append(window)
            count(room - length, 1)
    return windows, offsets


def pieces(docs: DataFrame, vocabulary: str, parts: str, end_id: int, capacity: int, digest: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, and each piece's ids, or with digest their crc32 as ids_crc32."""

    name, kind, last = ("ids_crc32", pa.int64(), "ids_crc32 long") if digest else ("ids", pa.list_(pa.int32()), "ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, parts).encode
        for batch in sliced(batches, 512):
            out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "ids")}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.array([end_id], ids.dtype)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for k, v in zip(out, (doc_id, start, len(piece), len(ids), crc32_of(piece) if digest else piece)):
                        out[k].append(v)
            columns = {k: pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"}
            columns[name] = pa.array(out["ids"], kind)
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return rows.mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, {last}")


def pack(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have doc_id, start and a length from 1 to capacity."""
    pieces = pieces.drop("sequence_id", "offset")
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in pieces.columns))  # no column of pieces begins so
    number, dealt = f"{own}row", f"{own}group"
    rows = staged(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn(dealt, F.pmod(F.xxhash64(number), F.lit(groups)))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", number], ascending=[False, True, True, True], na_position="first")
        windows, offsets = best_fit_decreasing(part["length"].to_numpy(), capacity)
        part["sequence_id"], part["offset"] = (part[dealt].to_numpy() << 32) + windows, offsets
        return part

    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.groupBy(dealt).applyInPandas(place, schema).drop(dealt, number)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces that carry ids: sequence_id, ids, doc_ids (one for each piece)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
