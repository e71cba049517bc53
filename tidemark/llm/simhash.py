"""Operator 7: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; their bit counts (0 to 2 each) embed it, and the Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints. Fingerprints within three
bits are within a Manhattan distance of three, so within one in one of the two halves of the embedding.
Each half is a grid whose cell is its 16 counts: a fingerprint sits in its cell and probes that cell and
those one step up in one count, which meets every pair within one step from one side or the other. What
meets is verified by the exact Hamming distance.

Copies are one node: only distinct fingerprints enter the grid, so a group of exact copies costs one row.
Links are joined on cells, between distinct fingerprints; they become components by star contraction.

Defined results: a null or empty text has fingerprint zero, linked like any other; null ids get a
fingerprint, and the smallest id of their component if it has one; equal rows each keep theirs; very long texts
count whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, staged, text_or_empty
from tidemark.llm.graph import components

SHINGLE, SEED, NEAR = 3, 42, 3
ROWS = 8192  # shingles whose bits are counted at a time


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    words = text.encode().lower().split()  # on bytes both keep to ASCII
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    raw = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [raw[s:e] for s, e in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())]


def hashes_of(text: str, size: int = SHINGLE) -> np.ndarray:
    """Of all shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in shingles(text, size)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """As an unsigned integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS):
        bits = np.unpackbits(hashes[at : at + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(hashes_of(t)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return rows.mapInArrow(compute, "doc_id long, fp long")


def counts_of(half: Column) -> Column:
    """The 16 bit counts of a half's segments, two bits for each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def cells(fp: Column) -> Column:
    """The cell in each half's grid; bit 32 tells the halves apart."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.array(counts_of(low), counts_of(F.shiftrightunsigned(fp, 32)) + F.lit(1 << 32).cast("long"))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: all pairs of distinct fingerprints that differ in at most three bits, once or twice each."""
    homes = nodes.select(F.col("fp").alias("b"), F.explode(cells(F.col("fp"))).alias("cell"))
    step = lambda i: F.shiftleft(F.lit(1).cast("long"), 2 * i)
    ups = [F.when(F.shiftright("own", 2 * i).bitwiseAND(F.lit(3).cast("long")) < 2, F.col("own") + step(i)) for i in range(16)]
    probes = homes.select(F.col("b").alias("a"), F.col("cell").alias("own"))
    probes = probes.select("a", "own", F.explode(F.filter(F.array("own", *ups), lambda c: c.isNotNull())).alias("cell"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR
    once = (F.col("own") != F.col("probe.cell")) | (F.col("a") < F.col("b"))
    return probes.alias("probe").join(homes.alias("home"), (F.col("probe.cell") == F.col("home.cell")) & near & once).select("a", "b")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component (a number, also where no id is known)."""
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(least, "root").select("fp", "component_id", F.col("root").alias("component"))
    labels = nodes.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    labels = staged(labels, "labels")  # a side of its own, so that Spark can split the other where a group of copies is hot
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labels, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "component")
