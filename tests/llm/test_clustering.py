"""Operator 11 against exhaustive assignment, and what its heaps spare."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import collected
from tests.support import duck, same
from tidemark.llm import clustering
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, k, rounds, scale, seed=1):
    """rows: id and integers; every distance is computed in every round."""
    hashed = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    at = [list(v) for _, _, v in sorted((hashed(i), v, v) for i, v in rows)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for turn in range(rounds + 1):
        own = [min(range(len(at)), key=lambda j: (far(v, at[j]), j)) for _, v in rows]
        if turn < rounds:
            for j in range(len(at)):
                here = [v for (_, v), o in zip(rows, own) if o == j]
                at[j] = [sum(x) // len(here) for x in zip(*here)] if here else at[j]
    cut = lambda x: min(x, (1 << 63) - 1)
    d = [far(v, at[o]) for (_, v), o in zip(rows, own)]
    inertia = [sum(x for x, o in zip(d, own) if o == j) for j in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, o, cut(x), cut(inertia[o]), cut(sum(d)), digest[o]) for (i, _), o, x in zip(rows, own, d)), key=repr)


def integers(vectors, scale):
    return [(i, [max(min(math.floor(x) * scale if abs(x) > 2**53 else math.floor(x * scale), 2**63 - 1), -(2**63)) for x in v]) for i, v in vectors]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def found(frame, **options):
    return collected(clustering.cluster(frame, **options), *COLUMNS)


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, cluster string, distance int")


def awkward():
    rnd = np.random.default_rng(5)
    vectors = [(i, (rnd.normal(size=4) * 2).tolist()) for i in range(120)]
    vectors += [(500 + i, vectors[3][1]) for i in range(60)] + [(7, vectors[7][1]), (7, vectors[8][1]), (None, [0.5, 1.5, -2.0, 0.0])]
    vectors += [(900 + i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(6)]  # ties between centroids
    return vectors, [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (405, [1.0] * 5)]


@pytest.mark.parametrize("k", [1, 2, 7, 300])
def test_by_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(clustering, "BLOCK", 16)
    vectors, odd = awkward()
    got = found(frame_of(spark, vectors + odd).repartition(3), k=k, rounds=4, scale=8, dims=4)
    assert got == plain(integers(vectors, 8), k, 4, 8)


def test_vectors_that_equal_a_centroid_and_huge_ones(spark):
    vectors = [(i, [float(x)] * 4) for i, x in enumerate([0, 0, 0, 1, 1, 2, 1e9, 3e9, 1e12, -1e15, 1e17, 1e300, -1e300, 2.0**53, 5e18])]
    for k in (3, 15):
        assert found(frame_of(spark, vectors), k=k, rounds=3, scale=64, dims=4) == plain(integers(vectors, 64), k, 3, 64)


def test_empty_tables(spark):
    assert clustering.cluster(frame_of(spark, [])).collect() == []
    assert clustering.cluster(frame_of(spark, [(1, None)])).columns == list(COLUMNS)


def test_only_expired_vectors_are_rescanned(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 256)
    rnd = np.random.default_rng(2)
    vectors = [(i, ([100.0 * (i % 5)] * 8 + rnd.normal(size=8)).tolist()) for i in range(2000)]
    turns = list(clustering.fitted(frame_of(spark, vectors), k=5, rounds=6, scale=16, dims=8))
    popped = [b.agg(F.sum("popped")).first()[0] for _, b in turns]
    assert len(popped) == 7 and popped[0] == 2000 and sum(popped[-2:]) < 400
    assert found(frame_of(spark, vectors), k=5, rounds=6, scale=16, dims=8) == plain(integers(vectors, 16), 5, 6, 16)


def test_same_as_sql_with_odd_rows(spark, tmp_path):
    rnd = np.random.default_rng(3)
    vectors = [(i, (rnd.normal(size=64) / 4).tolist()) for i in range(90)] + [(5, [0.25] * 64), (None, [0.1] * 64), (91, None), (92, [1.0] * 63), (93, [float("nan")] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    named = QUERIES["op11_clusters"](spark, str(tmp_path)).withColumn("vec_id", F.col("vec_id").cast("string"))
    same(named, duck(tmp_path).execute(f"select * replace (cast(vec_id as varchar) as vec_id) from ({ORACLE_SQL['op11_clusters']})").df())


def test_op11_same_as_sql(spark, small):
    same(QUERIES["op11_clusters"](spark, small), duck(small).execute(ORACLE_SQL["op11_clusters"]).df())
