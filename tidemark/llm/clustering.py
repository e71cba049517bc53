"""Operator 11: exact centroid clustering with heap-ordered bounds.

Vectors become integers and are cut, where they lie, into blocks of at most BLOCK rows. A block keeps a heap for
each cluster, keyed by the gap between a lower bound of a vector's distance to any other centroid and an upper
bound of that to its own. As centroids move, gaps shrink by no more than their own centroid's move and the
greatest other one; instead of lowering every key, a cluster adds both up as its drift, and a vector enters a heap
with its gap plus the drift until then. In each round only vectors whose key is within the drift are popped and
compared with all centroids again; the others can't have changed. Blocks report what left and entered clusters, so
centroids come from exact sums that change by the moved vectors alone.

A round reads the blocks and writes them anew to the shared folder; vectors are never shuffled. The driver holds
centroids, their sums and drifts: clusters x components numbers, however many vectors there are.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; a
null vec_id is as the empty text where the first centroids are chosen, and equal hashes go by the vectors; rows
that share a vec_id each count; with fewer vectors than clusters there are fewer centroids; an empty table gives no
rows; equal distances go to the smaller number; components, distances and inertia beyond a long are its nearest
value; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged

BLOCK = 4096
EXACT = 2**53  # integers below it are exact in doubles
LONGEST = (1 << 63) - 1
#: Bounds are widened by this share, which is far more than their rounding errors.
SLACK = 1e-9
FAR = 1e300  # the gap where there is no other centroid

#: heap_rows and heap_keys: the heaps of all clusters, one after another; hi, lo, counts: what came and went since the last round, by touched cluster.
STATE = "width int, vectors binary, heap_sizes array<int>, heap_rows binary, heap_keys binary, touched array<int>, hi array<long>, lo array<long>, counts array<long>, popped long"

ARROW = {
    "width": pa.int32(), "vectors": pa.binary(), "heap_sizes": pa.list_(pa.int32()), "heap_rows": pa.binary(), "heap_keys": pa.binary(),
    "touched": pa.list_(pa.int32()), "hi": pa.list_(pa.int64()), "lo": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "popped": pa.int64(),
}


@dataclass
class Centroids:
    """Positions, and for each what its heap's keys must exceed to stay."""

    at: list[list[int]]
    drift: list[float]

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        wide = max((abs(x) for c in self.at for x in c), default=0) >= EXACT
        return np.array(self.at, object if wide else np.float64), np.array(self.drift)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, v: components as doubles."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v): doubles where those are exact, else Python's integers, no farther than a long."""
    found = np.floor(v * float(scale))
    if np.abs(found).max(initial=0) < EXACT:
        return found
    whole = [max(min(math.floor(x) * scale if abs(x) >= EXACT else math.floor(x * scale), LONGEST), -LONGEST - 1) for x in v.ravel().tolist()]
    return np.array(whole, object).reshape(v.shape)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, by row and centroid."""
    most = max(float(np.abs(v).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * v.shape[1] * most * most < EXACT:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    rows, points = ([[int(x) for x in r] for r in m.tolist()] for m in (v, c))
    return np.array([[sum((x - y) ** 2 for x, y in zip(r, p)) for p in points] for r in rows], object).reshape(len(v), len(c))


def pack(v: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a component (0: decimal text) and the block's components."""
    most = np.abs(v).max(initial=0)
    width = next((w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1)), 0)
    if width:
        return width, v.astype(f"<i{width}").tobytes()
    return 0, ",".join(str(int(x)) for x in v.ravel().tolist()).encode()


def unpack(width: int, data: bytes, dims: int) -> np.ndarray:
    if not width:
        return np.array([int(x) for x in data.decode().split(",")], object).reshape(-1, dims)
    v = np.frombuffer(data, f"<i{width}").reshape(-1, dims)
    return v if width < 8 else v.astype(object)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, and a lower bound of how much farther the next one is."""
    found = distances(v, c)
    own = found.argmin(axis=1)
    lengths = np.sqrt(found.astype(np.float64))
    least = lengths[np.arange(len(v)), own]
    if found.shape[1] == 1:
        return own, np.full(len(v), FAR)
    lengths[np.arange(len(v)), own] = np.inf
    return own, lengths.min(axis=1) * (1 - SLACK) - least * (1 + SLACK)


def key(gap: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The drift at which a gap may have closed, rounded down."""
    return gap - SLACK * (np.abs(gap) + drift) + drift


def moved(v: np.ndarray, rows: Sequence[int], before: Sequence[int], after: Sequence[int]) -> dict[str, list]:
    """What clusters gained and lost by rows that went from one to another (before: -1 for new ones)."""
    rows, before, after = (np.asarray(x, np.int64) for x in (rows, before, after))
    changed = before != after
    rows, before, after = rows[changed], before[changed], after[changed]
    touched = sorted({*before.tolist(), *after.tolist()} - {-1})
    total, counts = [], []
    v = v.astype(np.int64) if v.dtype != object and np.abs(v).max(initial=0) < 1 << 31 else np.array([[int(x) for x in r] for r in v.tolist()], object).reshape(v.shape)
    for j in touched:
        came, went = rows[after == j], rows[before == j]
        total.append(v[came].sum(axis=0) - v[went].sum(axis=0))
        counts.append(len(came) - len(went))
    flat = [int(x) for t in total for x in t]
    return {"touched": touched, "hi": [x >> 32 for x in flat], "lo": [x & 0xFFFFFFFF for x in flat], "counts": counts}


def block_of(v: np.ndarray, heaps: list[list[tuple[float, int]]], popped: int, change: dict[str, list]) -> dict:
    width, data = pack(v)
    flat = [x for heap in heaps for x in heap]
    keys, rows = np.array([x[0] for x in flat], "<f8"), np.array([x[1] for x in flat], "<i4")
    return {"width": width, "vectors": data, "heap_sizes": [len(h) for h in heaps], "heap_rows": rows.tobytes(), "heap_keys": keys.tobytes(), "popped": popped} | change


def heaps_of(block: dict) -> list[list[tuple[float, int]]]:
    keys, rows = np.frombuffer(block["heap_keys"], "<f8").tolist(), np.frombuffer(block["heap_rows"], "<i4").tolist()
    flat, out, at = list(zip(keys, rows)), [], 0
    for n in block["heap_sizes"]:
        out.append(flat[at : at + n])  # written in heap order
        at += n
    return out


def begun(v: np.ndarray, centroids: Centroids) -> dict:
    """A block whose rows are all compared for the first time."""
    at, drift = centroids.packed()
    own, gaps = nearest(v, at)
    gaps = key(gaps, drift[own])
    heaps = [list(zip(gaps[own == j].tolist(), np.flatnonzero(own == j).tolist())) for j in range(len(at))]
    for h in heaps:
        heapq.heapify(h)
    return block_of(v, heaps, len(v), moved(v, range(len(v)), [-1] * len(v), own))


def advanced(block: dict, dims: int, centroids: Centroids) -> dict:
    """The block after one more assignment: expired rows are popped and rescanned."""
    at, drift = centroids.packed()
    heaps, rows, before = heaps_of(block), [], []
    for j, heap in enumerate(heaps):
        while heap and heap[0][0] <= drift[j]:
            rows.append(heapq.heappop(heap)[1])
            before.append(j)
    v = unpack(block["width"], block["vectors"], dims)
    after: list[int] = []
    if rows:
        own, gaps = nearest(v[rows], at)
        after = own.tolist()
        for row, j, expiry in zip(rows, after, key(gaps, drift[own]).tolist()):
            heapq.heappush(heaps[j], (expiry, row))
    return block_of(v, heaps, len(rows), moved(v, rows, before, after))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> Centroids:
    """The k vectors whose ids hash least."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("v", lambda x: F.floor(x * scale))  # as far as a long goes; those beyond tie, and go by v
    chosen = rows.select(hashed.alias("h"), "v", whole.alias("whole")).orderBy("h", "whole", "v").limit(k).collect()
    at = [[int(x) for x in integers(np.array([r["v"]]), scale)[0]] for r in chosen]
    return Centroids(at, [0.0] * len(at))


def changes(blocks: DataFrame, dims: int) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Sums that clusters gained by component, and how many vectors; clusters x components rows at most."""
    parts = blocks.where(F.size("touched") > 0)
    each = parts.select("touched", F.posexplode(F.arrays_zip("hi", "lo")).alias("i", "x"))
    each = each.select(F.col("touched")[F.floor(F.col("i") / dims).cast("int")].alias("j"), (F.col("i") % dims).alias("d"), "x.hi", "x.lo")
    sums = each.groupBy("j", "d").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("hi", "lo")))
    number = parts.select(F.explode(F.arrays_zip("touched", "counts")).alias("x")).groupBy(F.col("x.touched").alias("j")).agg(F.sum("x.counts").alias("n"))
    return {(r["j"], r["d"]): (int(r["hi"]) << 32) + int(r["lo"]) for r in sums.collect()}, {r["j"]: r["n"] for r in number.collect()}


def updated(centroids: Centroids, sums: list[list[int]], counts: list[int]) -> Centroids:
    """The means of what clusters hold, and drifts grown by how far centroids went."""
    at = [[x // n for x in s] if n else old for old, s, n in zip(centroids.at, sums, counts)]
    went = [math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) * (1 + SLACK) for a, b in zip(at, centroids.at)]
    drift = []
    for j, d in enumerate(centroids.drift):
        others = max((w for i, w in enumerate(went) if i != j), default=0.0)
        drift.append((d + went[j] + others) * (1 + SLACK))
    return Centroids(at, drift)


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks as rows of plain values, but for their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in ARROW} | {"ids": batch.column("ids").slice(i, 1)}


def record(block: dict) -> pa.RecordBatch:
    return pa.record_batch([block["ids"], *(pa.array([block[c]], kind) for c, kind in ARROW.items())], ["ids", *ARROW])


def fitted(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> Iterator[tuple[Centroids, DataFrame]]:
    """After each assignment, the centroids that it was to and the blocks with their heaps; one more than rounds."""
    rows = usable(vectors, dims)
    centroids = first_centroids(rows, k, seed, scale)
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), *T.StructType.fromDDL(STATE).fields])

    def begin(batches: Iterator[pa.RecordBatch], centroids: Centroids = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = integers(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield record(begun(v, centroids) | {"ids": ids})

    blocks = staged(rows.mapInArrow(begin, schema), "blocks")
    yield centroids, blocks
    sums, counts = [[0] * dims for _ in centroids.at], [0] * len(centroids.at)
    for _ in range(rounds):
        gained, number = changes(blocks, dims)
        for (j, d), x in gained.items():
            sums[j][d] += x
        for j, n in number.items():
            counts[j] += n
        centroids = updated(centroids, sums, counts)

        def advance(batches: Iterator[pa.RecordBatch], centroids: Centroids = centroids) -> Iterator[pa.RecordBatch]:
            for block in blocks_in(batches):
                yield record(advanced(block, dims, centroids) | {"ids": block["ids"]})

        blocks = staged(blocks.mapInArrow(advance, schema), "blocks")
        yield centroids, blocks


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    for centroids, blocks in fitted(vectors, k, rounds, scale, dims, seed):  # noqa: B007
        pass

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            v, own = unpack(block["width"], block["vectors"], dims), np.empty(sum(block["heap_sizes"]), np.int32)
            own[np.frombuffer(block["heap_rows"], "<i4")] = np.repeat(np.arange(len(block["heap_sizes"])), block["heap_sizes"])
            far = np.empty(len(own), object)
            for j, point in enumerate(centroids.at):
                here = np.flatnonzero(own == j)
                far[here] = distances(v[here], np.array([point], object))[:, 0]
            far = pa.array([min(int(x), LONGEST) for x in far.tolist()], pa.int64())
            yield pa.record_batch([block["ids"].flatten(), pa.array(own), far], ["vec_id", "cluster", "distance"])

    kind = T.StructType([T.StructField("vec_id", blocks.schema["ids"].dataType.elementType), *T.StructType.fromDDL("cluster int, distance long").fields])
    found = staged(blocks.mapInArrow(placed, kind), "clusters")
    sizes = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    whole = min(sum(sizes.values()), LONGEST)
    digest = lambda point: hashlib.sha256(",".join(map(str, point)).encode()).hexdigest()
    by_cluster = [(j, min(sizes.get(j, 0), LONGEST), whole, digest(point)) for j, point in enumerate(centroids.at)]
    known = vectors.sparkSession.createDataFrame(by_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
