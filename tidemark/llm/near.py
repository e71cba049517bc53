"""Near copies of the pipeline: operator 7's links over five-word shingles, and those beyond its distance.

Texts whose sets of shingles have a Jaccard similarity of LEAST or more are linked. Candidates are the links
of operator 7, fingerprints of the same shingles within three bits by its grid join. At a similarity of 0.8
two fingerprints differ in about ten of 64 bits, too many for that join, so what lies beyond it comes from
MinHash: a text's BANDS cells are each made of WIDTH minima, and a pair at the least similarity misses all
cells with a probability of (1 - 0.8**5)**40, 1.2e-7. Every candidate pair, of either kind, is verified on the
two whole shingle sets, in integers.

Texts with one shingle set are one node. Pairs are verified in two rounds: first each node with the smallest
node of each of its cells, and operator 7's links, then all pairs of a cell that the first round left in
different components. A large group of near copies is therefore linked by its first round, not by all its pairs.

Nodes are told apart by 64-bit hashes of their sets, unverified: of a billion sets two are taken for one with a
probability of 0.03.

Defined results: null, empty and blank texts have the empty set and are one node; a text shorter than a
shingle is one shingle; letter case counts outside of ASCII only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carried, carried_of, sliced, staged, text_or_empty, with_carried
from tidemark.llm.graph import components
from tidemark.llm.simhash import SEED, fingerprint, hashes_of
from tidemark.llm.simhash import links as fingerprint_links

SHINGLE, LEAST = 5, (4, 5)  # words; similarity as a fraction
BANDS, WIDTH = 40, 5
ROWS = 1024  # shingles whose minima are taken at a time
FACTORS, MASKS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * WIDTH, 1), np.uint64) | np.array([[[1]], [[0]]], np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(hashes_of(text, SHINGLE))


def cells_of(hashes: np.ndarray) -> list[int]:
    """As signed longs; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * WIDTH, (1 << 64) - 1, "<u8")
    for at in range(0, len(hashes), ROWS):
        np.minimum(least, ((hashes[None, at : at + ROWS] ^ MASKS) * FACTORS).min(axis=1), out=least)
    found = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, WIDTH))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def sketched(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """node (a hash of the shingle set), n (its size), fp (the fingerprint), cells, and carried, a struct of the columns of carry."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [hashes_of(t, SHINGLE) for t in batch.column("text").to_pylist()]
            prints, sets = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64), [np.unique(h) for h in hashes]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = {"node": pa.array(nodes), "n": pa.array([len(s) for s in sets], pa.int32()), "fp": pa.array(prints), "cells": pa.array([cells_of(s) for s in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns | carried_of(batch))

    rows = docs.select(text_or_empty(), *carried(docs, carry))
    return rows.mapInArrow(sketch, with_carried(rows, "node long, n int, fp long, cells array<long>"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pairs a, b of nodes that are similar enough, by the texts of their first rows."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    firsts = nodes.join(involved, "node").select("node", *(F.col(f"first.{k}").alias(k) for k in key))
    texts = docs.select(text_or_empty(), *key).join(firsts, list(key)).select("node", "text").dropDuplicates(["node"])
    texts = staged(texts, "near-texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            texts_of = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            keep = pa.array([alike(shingle_set(a), shingle_set(b)) for a, b in texts_of], pa.bool_())
            yield pa.RecordBatch.from_pydict({k: batch.column(k).filter(keep) for k in ("a", "b")})

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def within_distance(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of one fingerprint with the smallest of them, and the smallest nodes of linked fingerprints."""
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    same = nodes.join(prints, "fp").where("a != node").select("a", F.col("node").alias("b"))
    links = fingerprint_links(prints).toDF("fp_a", "fp_b")
    links = links.join(prints.toDF("fp_a", "x"), "fp_a").join(prints.toDF("fp_b", "y"), "fp_b")
    return same.union(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def firsts(docs: DataFrame, key: Sequence[str]) -> DataFrame:
    """The smallest key of each component. key: columns of docs that tell rows with different texts apart, none null."""
    rows = staged(sketched(docs, key), "sketches")
    nodes = staged(rows.groupBy("node").agg(F.min("carried").alias("first"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("cells").alias("cells")), "nodes")
    cells = nodes.select("node", "n", F.explode("cells").alias("cell"))
    hubs = cells.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("n", "node").alias("hub_n")).where("hub < last")
    shared = staged(cells.join(hubs, "cell").select("cell", "node", "n", "hub", "hub_n"), "cells")

    def fit(n: str, m: str) -> F.Column:
        return LEAST[1] * F.least(n, m) >= LEAST[0] * F.greatest(n, m)

    stars = shared.where((F.col("hub") != F.col("node")) & fit("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = staged(stars.union(within_distance(nodes)).distinct(), "stars")
    links = staged(verified(stars, docs, nodes, key), "near-links")
    labelled = shared.select("cell", "node", "n").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = staged(labelled, "labelled")
    mixed = labelled.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    left = labelled.join(mixed, "cell", "left_semi")
    one, two = left.toDF("a", "cell", "n_a", "root_a"), left.toDF("b", "cell", "n_b", "root_b")
    rest = one.join(two, "cell").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fit("n_a", "n_b")).select("a", "b").distinct()
    rest = staged(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    links = links.union(verified(rest, docs, nodes, key))
    named = nodes.select("node", "first").join(components(links), "node", "left")
    stay = named.groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("first").alias("first"))
    return stay.select(*(F.col(f"first.{k}").alias(k) for k in key))
