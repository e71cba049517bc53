"""Operator 1: toxicity by multiple-instance learning.

A sentence's probability is a logistic function of its words' weights; a document's is the noisy-or of its
sentences and of a constant term. Only document labels train it: learn() takes at most PER_CLASS labelled
rows a class (smallest hashes first), finds among their words, word beginnings and word endings the FEATURES
most associated with the label, and fits the weights by gradient descent on the noisy-or likelihood, weighting
classes back to their share among all labelled rows. score() covers every whole text and returns the
sentences at fault.

The fit is on the driver, over the chosen features of the sampled rows' sentences: bounded by PER_CLASS
and FEATURES. Sampled rows train with their whole texts; of a sentence only its hits are kept.

Defined results: a null or empty text has no sentence and gets the constant term's score; a document with
several labels is toxic if one says so; null labels and labels without a document teach nothing; without
toxic or without clean rows every score is the share of toxic rows (0 if none); equal rows each keep theirs;
very long texts are scored whole, sentence by sentence; an empty table gives no rows, and an empty one to
learn from a score of 0; other columns are ignored, or carried in a struct where no name clashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import carried, carried_of, sliced, staged, thinned, with_carried

PER_CLASS, FEATURES = 4000, 2048
BEGINNINGS, ENDINGS = (3, 4, 5, 6), (4, 5, 6)
LEAST_DOCS, LEAST_Z = 3, 3.0
MEMO = 200_000  # words whose weights a task keeps

SENTENCES = re.compile(r"[^.!?\n]+[.!?]*").finditer
WORDS = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings, marked by hyphens."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n), *("-" + word[-n:] for n in ENDINGS if len(word) > n)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float  #: what the constant term adds to -log(1 - p)


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The sample as doc, toxic, text; labelled rows by class."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    hashed = F.xxhash64("doc_id")
    order = Window.partitionBy("toxic").orderBy(hashed, "doc_id")
    chosen = thinned(known, "toxic", sizes, hashed, PER_CLASS).withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_CLASS).drop("k")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # A doc_id that many rows share teaches once.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select(F.col("doc_id").alias("doc"), "toxic", "text"), sizes


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows, sizes = sampled(docs, labels)
    rows = staged(rows, "toxicity-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                found = sorted({f for w in set(WORDS(text.lower())) for f in features(w)})
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * len(found), pa.int32()), "feature": pa.array(found, pa.string())})

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if not n.get(0) or not n.get(1):
        share = sizes.get(1, 0) / total if total else 0.0
        return Model({}, -50.0, float(-np.log1p(-min(share, 1 - 1e-9))))
    by_feature = rows.mapInArrow(present, "toxic int, feature string").groupBy("feature").agg(F.sum("toxic").alias("hit"), F.count(F.lit(1)).alias("docs"))
    share = n[1] / (n[0] + n[1])
    z = (F.col("hit") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share))
    top = by_feature.where(F.col("docs") >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    names = sorted(r["feature"] for r in top.orderBy(F.desc("z"), "feature").limit(FEATURES).collect())
    index = {f: i for i, f in enumerate(names)}

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document: the number of its sentences, and the sentence and feature of each hit."""
        for batch in sliced(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                count, at, hits = 0, [], []
                for m in SENTENCES(text):
                    words = WORDS(m.group().lower())
                    if words:
                        got = [index[f] for w in words for f in features(w) if f in index]
                        at += [count] * len(got)
                        hits += got
                        count += 1
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic], pa.int32()), "sentences": pa.array([count], pa.int32()), "at": pa.array([at], pa.list_(pa.int32())), "hits": pa.array([hits], pa.list_(pa.int32()))})

    bags = rows.mapInArrow(instances, "toxic int, sentences int, at array<int>, hits array<int>")
    order = F.xxhash64("toxic", "sentences", "at", "hits")  # the sum's order, so that equal samples give equal weights
    bags = bags.sort(order).toPandas()
    return fit(bags["toxic"].to_numpy(), bags["sentences"].to_numpy(), list(bags["at"]), list(bags["hits"]), names, {k: sizes[k] / n[k] for k in n})


def fit(toxic: np.ndarray, sentences: np.ndarray, at: list, hits: list, names: list[str], weight: dict[int, float], steps: int = 600, rate: float = 0.08, ridge: float = 2e-3) -> Model:
    """Gradient descent (Adam) on the mean weighted log-likelihood of the noisy-or.

    Sentences without a chosen feature are all alike, so a document's are one term times their number.
    """
    starts = np.concatenate([[0], np.cumsum(sentences)])
    where = np.concatenate([np.asarray(a, np.int64) + s for a, s in zip(at, starts)] or [[]]).astype(np.int64)
    what = np.concatenate([np.asarray(h, np.int64) for h in hits] or [[]]).astype(np.int64)
    busy, row = np.unique(where, return_inverse=True)
    doc_of = np.searchsorted(starts, busy, "right") - 1  # of each busy sentence
    plain = sentences - np.bincount(doc_of, minlength=len(toxic))
    per_doc = np.where(toxic == 1, weight[1], weight[0])
    per_doc = per_doc / per_doc.sum()
    theta = np.concatenate([np.zeros(len(names)), [-6.0, -4.0]])  # weights, bias, constant term
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, const = theta[:-2], theta[-2], theta[-1]
        z = bias + np.bincount(row, w[what], len(busy))
        p, p_plain, p_const = (1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (z, bias, const))
        soft = np.logaddexp(0, z)
        a = np.bincount(doc_of, soft, len(toxic)) + plain * np.logaddexp(0, bias) + np.logaddexp(0, const)
        slope = per_doc * np.where(toxic == 1, -1 / np.expm1(np.clip(a, 1e-9, 700)), 1.0)
        dz = slope[doc_of] * p
        grad = np.concatenate([np.bincount(what, dz[row], len(names)) + ridge * w / len(names), [dz.sum() + (slope * plain).sum() * p_plain, slope.sum() * p_const]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        theta = theta - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, theta) if x}, float(theta[-2]), float(np.logaddexp(0, theta[-1])))


def softplus(z: float) -> float:
    return float(np.logaddexp(0, z))


def score(docs: DataFrame, model: Model, offending: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, score, predicted, and the spans (start, end, probability) of sentences from offending on; with carry also carried, a struct of those columns."""
    weights, bias, plain = model.weights, model.bias, softplus(model.bias)
    begins, ends = {f[:-1]: w for f, w in weights.items() if f[-1] == "-"}, {f[1:]: w for f, w in weights.items() if f[0] == "-"}
    whole = {f: w for f, w in weights.items() if "-" not in f}
    memo: dict[str, float] = {}

    def weight(word: str) -> float:
        if len(memo) > MEMO:
            memo.clear()
        n, w = len(word), whole.get(word, 0.0)
        for k in BEGINNINGS:
            if n >= k:
                w += begins.get(word[:k], 0.0)
        for k in ENDINGS:
            if n > k:
                w += ends.get(word[-k:], 0.0)
        memo[word] = w
        return w

    def judge(text: str) -> tuple[float, list]:
        a, spans = model.leak, []
        for m in SENTENCES(text):
            words = WORDS(m.group().lower())
            if not words:
                continue
            z = 0.0
            for w in words:
                x = memo.get(w)
                z += weight(w) if x is None else x
            if z == 0.0:
                a += plain
                continue
            s = softplus(bias + z)
            a += s
            if (p := -float(np.expm1(-s))) >= offending:
                spans.append({"start": m.start(), "end": m.end(), "score": p})
        return -float(np.expm1(-a)), spans

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [judge(t or "") for t in batch.column("text").to_pylist()]
            p = np.array([f[0] for f in found])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32)), "spans": pa.array([f[1] for f in found], kind)} | carried_of(batch))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried(docs, carry))
    return rows.mapInArrow(judged, with_carried(rows, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"))
