"""Operator 8: exact top-k inner products by block-at-a-time pruning.

Vectors become integers, are ordered by their nearest of up to PIVOTS sampled vectors, and cut into document-range
blocks of at most BLOCK. A block keeps each term's greatest and least value, whose sums with a query's terms
bound any score in it, and its vectors as a forward index. The bounds of all blocks order them for each query:
the first is scored whole and gives a k-th score; of the blocks whose bounds reach it, those on the shelf of
the next best are scored, then those on other shelves whose bounds still reach the k-th score so far. On a
shelf (2**SHELF neighbouring blocks) blocks are taken in descending order of their bounds until one falls
below. A query meets no shelf that has nothing for it.

Bounds are taken from the blocks' extremes alone, by groups of about GROUP blocks and chunks of CHUNK
queries; a task holds one of each, or a shelf and the queries of a chunk that reach it.

Defined results: vectors that are null or empty or hold null or non-finite components, and null ids, take no
part; of rows that share a vec_id each is a candidate and a query of its own, and only a query's own row is
no candidate of it; vectors are compared with those of their own length; equal scores go to the smaller
vec_id; scores beyond a long are its nearest value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

PIVOTS, BLOCK, SHELF, GROUP, CHUNK = 64, 256, 4, 4096, 1024
EXACT = 2.0**53  # sums of integers below it are exact in doubles
LONGEST = (1 << 63) - 1

BLOCKS = "block long, dim int, most binary, least binary, rows binary, ids binary, vectors binary"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), vec_id, dim, v (components as doubles), scale."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("v") > 0) & F.col("vec_id").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v", F.lit(scale).alias("scale"))


def whole_numbers(batch: pa.RecordBatch | pd.DataFrame) -> np.ndarray:
    """The rows' vectors, all of one length, times scale and floored."""
    return np.floor(np.stack(batch["v"].to_numpy()) * float(batch["scale"].iloc[0]))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; beyond doubles in Python's integers."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], object).reshape(len(a), len(b))


def bounds_of(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """By query and block, at least every score there; as doubles, rounded up where they aren't exact."""
    found = dot(np.maximum(q, 0), most) + dot(np.minimum(q, 0), least)
    if found.dtype != object:
        return found
    found = found.astype(np.float64)
    return found + np.abs(found) * 2.0**-50


def shelf_of(block: str) -> Column:
    return F.shiftright(block, SHELF)


def blocks_of(rows: DataFrame) -> DataFrame:
    some = min(PIVOTS, max(1, rows.count() // BLOCK))
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(some).toPandas()
    pivots = {d: (x := whole_numbers(g)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1) for d, g in sample.groupby("dim")}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                by = pivots.get(dim)
                yield part.assign(pivot=0 if by is None else (whole_numbers(part) @ by.T).argmax(axis=1).astype(np.int32))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of one length and pivot, numbered from the task's number on."""
        number, held = TaskContext.get().partitionId() << 32, None

        def out(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            v = whole_numbers(part)
            binary = {"most": v.max(axis=0), "least": v.min(axis=0), "rows": part["row"].to_numpy("<i8"), "ids": part["vec_id"].to_numpy("<i8"), "vectors": v}
            return pd.DataFrame({"block": [number], "dim": [np.int32(v.shape[1])]} | {k: [x.tobytes()] for k, x in binary.items()})

        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch])
            held = None
            parts = list(batch.groupby(["dim", "pivot"], sort=False))
            for i, (_, part) in enumerate(parts):
                for at in range(0, len(part), BLOCK):
                    if i == len(parts) - 1 and len(part) - at <= BLOCK:
                        held = part.iloc[at:]
                    else:
                        yield out(part.iloc[at : at + BLOCK])
        if held is not None:
            yield out(held)

    placed = rows.mapInPandas(nearest, "row long, vec_id long, dim int, v array<double>, scale int, pivot int")
    placed = placed.repartitionByRange("dim", "pivot", "vec_id", "row").sortWithinPartitions("dim", "pivot", "vec_id", "row")
    return placed.mapInPandas(cut, BLOCKS)


def bounded(queries: DataFrame, blocks: DataFrame, chunks: int, groups: int) -> DataFrame:
    """row, chunk, shelf, blocks, bounds: by shelf, the blocks whose bounds reach a query's floor; a group's best alone where the floor is null.

    queries: row, chunk, dim, v, scale, floor.
    """
    extremes = blocks.select("block", "dim", "most", "least", F.pmod(F.xxhash64(shelf_of("block")), F.lit(groups)).alias("group"))
    out = {"row": "int64", "chunk": "int64", "shelf": "int64", "blocks": "object", "bounds": "object"}

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({k: [] for k in out}).astype(out)
        right = right.sort_values("block")
        numbers = right["block"].to_numpy()
        shelves, at = np.unique(numbers >> SHELF, return_index=True)
        most, least = (np.stack([np.frombuffer(x, "<f8") for x in right[c]]) for c in ("most", "least"))
        found = {k: [] for k in out}
        all_bounds = bounds_of(whole_numbers(left), most, least)
        for row, chunk, floor, bounds in zip(left["row"].tolist(), left["chunk"].tolist(), left["floor"].tolist(), all_bounds):
            reach = bounds >= floor if floor == floor and floor is not None else np.arange(len(bounds)) == bounds.argmax()
            for shelf, some in zip(shelves.tolist(), np.split(np.arange(len(bounds)), at[1:])):
                some = some[reach[some]]
                if len(some):
                    for k, v in zip(found, (row, chunk, shelf, numbers[some], bounds[some])):
                        found[k].append(v)
        return pd.DataFrame(found).astype(out)

    asking = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    asked = extremes.withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>")))
    asked = asked.withColumnsRenamed({"dim": "to_dim", "group": "to_group"})
    met = asking.groupBy("dim", "chunk", "group").cogroup(asked.groupBy("to_dim", "to_chunk", "to_group"))
    return met.applyInPandas(meet, "row long, chunk long, shelf long, blocks array<long>, bounds array<double>")


def best_of(q: np.ndarray, own: int, k: int, floor: float, order: Iterator[tuple[float, tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows that reach the floor but the query's own, best first. order: bounds and blocks, greatest bound first."""
    got_ids, got = np.empty(0, np.int64), np.empty(0)
    for bound, (rows, ids, vectors) in order:
        least = got[-1] if len(got) == k else floor
        if bound < least:
            break
        scores = dot(q, vectors)[0]
        keep = (rows != own) & (scores >= least)
        if keep.any():
            got_ids, got = np.concatenate([got_ids, ids[keep]]), np.concatenate([got, scores[keep]])
            best = np.lexsort((got_ids, -got))[:k]
            got_ids, got = got_ids[best], got[best]
    return got_ids, got


def scored(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """row, vec_id, score: by shelf, a query's k best rows of the blocks that it is paired with, from its floor on.

    pairs: row, chunk, shelf, blocks, bounds, floor.
    """

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "vec_id": [], "score": []}
        held = {}
        for r in right.itertuples():
            rows, ids = (np.frombuffer(x, "<i8") for x in (r.rows, r.ids))
            held[r.block] = rows, ids, np.frombuffer(r.vectors, "<f8").reshape(len(rows), -1)
        for own, floor, numbers, bounds, i in zip(left["row"].tolist(), left["floor"].tolist(), left["blocks"], left["bounds"], range(len(left))):
            q = whole_numbers(left.iloc[i : i + 1])  # a shelf's blocks may differ in length
            order = ((bounds[j], held[numbers[j]]) for j in np.argsort(-bounds, kind="stable"))
            found, scores = best_of(q, own, k, float("-inf") if floor is None or floor != floor else floor, order)
            out["row"] += [own] * len(found)
            out["vec_id"] += found.tolist()
            out["score"] += [max(min(int(x), LONGEST), -LONGEST - 1) for x in scores]
        return pd.DataFrame(out).astype("int64")

    asking = pairs.select("row", "chunk", "shelf", "blocks", "bounds", "floor").join(queries.select("row", "v", "scale"), "row")
    wanted = pairs.select("shelf", F.col("chunk").alias("to_chunk")).distinct()
    asked = blocks.withColumn("shelf", shelf_of("block")).join(wanted, "shelf").select(F.col("shelf").alias("to_shelf"), "to_chunk", "block", "rows", "ids", "vectors")
    met = asking.groupBy("shelf", "chunk").cogroup(asked.groupBy("to_shelf", "to_chunk"))
    return met.applyInPandas(meet, "row long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs_of(queries: DataFrame, blocks: DataFrame, k: int, chunks: int, groups: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """In turn, the pairs to score next, and the best scores so far with theirs."""
    if groups == 1 and blocks.select(shelf_of("block")).distinct().count() <= 1:  # nothing to choose between shelves
        every = bounded(queries.withColumn("floor", F.lit(float("-inf"))), blocks, chunks, groups).withColumn("floor", F.lit(float("-inf")))
        yield every, best(scored(every, queries, blocks, k), k)
        return
    none = F.lit(None).cast("double")
    firsts = bounded(queries.withColumn("floor", none), blocks, chunks, groups).withColumn("bound", F.col("bounds")[0])
    firsts = firsts.groupBy("row").agg(F.max_by(F.struct("chunk", "shelf", "blocks", "bounds"), F.struct("bound", "blocks")).alias("p")).select("row", "p.*")
    firsts = staged(firsts.withColumn("floor", none), "first-pairs")
    found = staged(best(scored(firsts, queries, blocks, k), k), "found")
    yield firsts, found

    def floored(rows: DataFrame, found: DataFrame) -> DataFrame:
        """With the k-th score so far; where there are fewer, everything reaches."""
        floors = found.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
        return rows.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    reached = bounded(floored(queries, found), blocks, chunks, groups).join(firsts.select("row", F.col("blocks")[0].alias("first")), "row")
    # A first block's rows are found already.
    left = F.filter(F.arrays_zip("blocks", "bounds"), lambda x: x["blocks"] != F.col("first"))
    reached = reached.withColumn("left", left).where(F.size("left") > 0)
    reached = reached.select("row", "chunk", "shelf", F.col("left.blocks").alias("blocks"), F.col("left.bounds").alias("bounds"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc(F.array_max("bounds")), "shelf"))
    reached = staged(reached.withColumn("place", place), "reached")
    ahead = floored(reached.where(F.col("place") == 1), found)
    found = staged(best(found.drop("rank").union(scored(ahead, queries, blocks, k)), k), "found")
    yield ahead, found
    rest = floored(reached.where(F.col("place") > 1), found).where(F.array_max("bounds") >= F.col("floor"))
    yield rest, best(found.drop("rank").union(scored(rest, queries, blocks, k)), k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    rows = staged(usable(vectors, scale), "vectors")
    blocks = staged(blocks_of(rows), "blocks")
    asking = rows.where(is_query)
    chunks, groups = (max(1, -(-n // most)) for n, most in ((asking.count(), CHUNK), (blocks.count(), GROUP)))
    queries = asking.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    for _, found in pairs_of(queries, blocks, k, chunks, groups):
        pass
    return found.join(asking.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
