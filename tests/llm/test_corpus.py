"""Operators 3, 7 and 8 against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROWS, clashing, collected, documents
from tests.support import duck, same
from tidemark.llm import graph, lm, simhash, topk
from tidemark.llm.common import fold
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def trains(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def plain_model(texts, order):
    """P(word | context) by its definition."""
    grams = Counter()
    for t in texts:
        path = ["", *tokens(t)]
        grams.update(tuple(path[max(i - n + 1, 0) : i + 1]) for i in range(1, len(path)) for n in range(1, order + 1) if n <= i + 1)
    words = {g[0]: c for g, c in grams.items() if len(g) == 1}
    contexts = Counter()
    for g, c in grams.items():
        contexts[g[:-1]] += c
    n, once, twice = (sum(words.values()), *(sum(c == k for c in words.values()) for k in (1, 2)))
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)

    def p(h, w):
        if not h:
            return 1.0 if not n else (words[w] - d) / n if w in words else d * len(words) / n
        if not contexts[h]:
            return p(h[1:], w)
        left = lm.BACKOFF * contexts[h] ** -lm.POWER
        return (1 - left) * grams[*h, w] / contexts[h] + left * p(h[1:], w)

    return p, words


def check_lm(frame, docs, order=lm.ORDER):
    """All columns of frame, against docs as (doc_id, text)."""
    p, counts = plain_model([t for d, t in docs if trains(d)], order)
    n, v, want = sum(counts.values()), len(counts), []
    for d, t in docs:
        path = ["", *tokens(t)]
        logs = [math.log10(p(tuple(path[max(i - order + 1, 0) : i]), path[i])) for i in range(1, len(path))]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in path[1:])
        want.append((d, len(path) - 1, sum(w in counts for w in path[1:]), n, round(base, 4), round(sum(logs), 4)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in frame]
    key = lambda r: repr(r[:4])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-3)


def test_op3_by_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op3_lm"](spark, small).collect()
    check_lm(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("order", "part"), [(1, 1000), (2, 10**9), (3, 500), (4, 20_000)])
def test_lm_of_awkward_documents(spark, monkeypatch, order, part):
    monkeypatch.setattr(lm, "PART", part)  # parts and shards, one or many, change nothing
    monkeypatch.setattr(lm, "SHARD", 2 * part)
    monkeypatch.setattr(lm, "RUN", 64)
    rows = lm.score(clashing(documents(spark)), fold("doc_id", 7) != 2, order=order).collect()
    check_lm(rows, [r[:2] for r in ROWS], order=order)


def test_lm_with_nothing_to_learn_from(spark):
    nothing = lm.score(documents(spark), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in nothing} == {(0, 0, 0.0)}
    assert lm.score(documents(spark, []), fold("doc_id", 7) != 2).count() == 0


def test_lm_tells_documents_that_occur_twice(spark, small):
    """The text that has a copy in training is likelier, by token, than one without."""
    import random

    rnd = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=120)) for _ in range(60)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts + texts[:10])]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(documents(spark, rows), F.lit(True)).collect()}
    assert min(got[i] for i in range(10)) > max(got[i] for i in range(10, 60))


def test_each_state_s_distribution_sums_to_one():
    texts = ["a b a c", "a b b", "c a b", ""]
    p, words = plain_model(texts, 3)
    for h in ((), ("",), ("a",), ("a", "b"), ("", "a"), ("b", "b")):
        assert sum(p(h, w) for w in [*words, "unseen"]) == pytest.approx(1)


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The least index reachable from each, over fingerprints within three bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_op7(spark, small):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    want = [(d, f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, plain_components(prints))]
    assert collected(QUERIES["op7_simhash"](spark, small), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_simhash_of_awkward_documents(spark):
    rows = simhash.grouped(clashing(documents(spark))).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == 2 and by[6]["component_id"] == 1 and by[None]["component_id"] is None
    assert simhash.grouped(documents(spark, [])).count() == 0


def test_links_lose_no_pair(spark):
    rnd = np.random.default_rng(3)
    seeds = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(seeds.tolist()) | {0, (1 << 64) - 1}
    for s in seeds.tolist():
        for _ in range(12):
            prints.add(s ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(1, 6), replace=False)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    got = {tuple(sorted((r["a"], r["b"]))) for r in found}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)] + [(200, 300 + i) for i in range(50)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and {got[300 + i] for i in range(50)} == {200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_topk(rows, is_query, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            scores = sorted((-int(np.dot(v, w)), c) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def integers(rows):
    return [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]


def test_topk_by_brute_force(spark, monkeypatch, tmp_path):
    for name, size in (("BLOCK", 16), ("GROUP", 5), ("CHUNK", 3), ("SHELF", 1)):
        monkeypatch.setattr(topk, name, size)
    rnd = np.random.default_rng(1)
    vectors = [(i, (rnd.normal(size=8) / 3).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)]  # a very common vector
    vectors += [(2000 + i, [0.5, float(i)]) for i in range(4)]  # of another length
    vectors += [(100, vectors[7][1]), (5, vectors[6][1]), (5, vectors[6][1])]  # ids that rows share
    odd = [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, label int, score string, rank int")
    got = topk.search(frame, F.col("vec_id") % 50 == 0)
    want = plain_topk(integers(vectors), lambda i: i % 50 == 0, 5)
    assert collected(got, "query_id", "rank", "vec_id", "score") == want
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(QUERIES["op8_topk"](spark, str(tmp_path)), duck(tmp_path).execute(ORACLE_SQL["op8_topk"]).df())
    assert topk.search(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_few_blocks_are_scored(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(64, 16)) * 2
    vectors = [(i, (centres[i % 64] + rnd.normal(size=16) / 8).astype(np.float32).tolist()) for i in range(4096)]
    rows = topk.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), 256).persist()
    blocks = topk.blocks_of(rows).persist()
    queries = rows.where("vec_id % 50 = 0").withColumn("chunk", F.lit(0).cast("long"))
    turns = list(topk.pairs_of(queries, blocks, 5, 1, 1))
    n_scored = sum(len(r["blocks"]) for pairs, _ in turns for r in pairs.collect())
    assert n_scored < queries.count() * blocks.count() / 8
    got = turns[-1][1].join(rows.select("row", F.col("vec_id").alias("query_id")), "row")
    assert collected(got, "query_id", "rank", "vec_id", "score") == plain_topk(integers(vectors), lambda i: i % 50 == 0, 5)


def test_scores_beyond_doubles_are_exact():
    big = np.array([[2.0**40, 1.0]])
    assert topk.dot(big, big)[0][0] == 2**80 + 1


def test_lm_parts_send_no_empty_rows():
    texts = [" ".join(f"w{(7 * i + k) % 50}" for k in range(40)) for i in range(20)]
    for shards in (1, 1000, 10**6):
        for table, n in zip(lm.asked(3, texts, [True] * 10 + [False] * 10, shards, 3, 64), (1, 2, 3)):
            keys = [np.cumsum(lm.unpacked(k, "<u8"), dtype=np.uint64) for k in table["keys"].to_pylist()]
            distinct = np.unique(np.concatenate(keys))
            assert all(map(len, keys)) and len(table) <= min(shards, len(distinct)) and set(table["n"].to_pylist()) == {n}
            assert len(distinct) == sum(map(len, keys)) and (np.diff(table["shard"].to_numpy()) > 0).all()


def test_lm_scores_do_not_depend_on_parts_and_shards(spark, monkeypatch):
    docs = documents(spark, [(i, " ".join(f"w{(i * k) % 31}" for k in range(i % 17)), None, None, 0) for i in range(120)])
    scores = []
    for part, shard in ((8_000_000, 16_000_000), (300, 20), (50, 5)):
        monkeypatch.setattr(lm, "PART", part)
        monkeypatch.setattr(lm, "SHARD", shard)
        scores.append(sorted(map(tuple, lm.score(docs, fold("doc_id", 7) != 2).collect())))
    assert scores[0] == scores[1] == scores[2] or all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:]) for s in scores[1:] for a, b in zip(scores[0], s))
