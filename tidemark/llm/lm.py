"""Operator 3: language-model scoring by a weighted backoff automaton.

Every n-gram of the training texts, of one to order words, is an arc, and every shorter one a state too. The
arc of a word after a context carries the word's smoothed log probability there and leads to the state of the
longest context that the word ends; a state fails to the next shorter context at the price of its backoff
weight, down to the root, where unseen words share one outcome. One traversal of a text, left to right,
carries the state and adds weights up. A context leaves b(h) = BACKOFF c(h)^-POWER to its shorter context,
P(w | h) = (1 - b(h)) c(h, w) / c(h) + b(h) P(w | shorter h), so contexts seen often are trusted more; words
are smoothed by absolute discounting. Each state's distribution sums to one, and no count is too small to be
an arc.

The model is as large as the corpus, so no task holds it. Texts are dealt by hash into parts of about PART
characters. A part sends the distinct n-grams of its texts, as sorted hashes with their counts in training
texts, to shards by hash, a row to each shard that gets any; a shard adds the counts of all parts up and answers
each part with the totals of what it sent, in its order. Totals over all words are counted before. A part then compiles the arcs and states that its own texts can meet, and
traverses them. A frequent n-gram is sent once by each part, so no shard is hot; both exchanges follow the
number of distinct n-grams by part, and a task's memory PART, or its longest text where that is longer.
Words have 64-bit hashes; those of longer n-grams keep SPARE bits beyond the logarithm of the corpus's size,
so that fewer than one in a million shares its hash with another, at any size.

Defined results: a null or empty text is the end token alone; equal rows each keep theirs; null ids are as
the empty text in the fold; an empty table gives no rows; with nothing to learn from every token is unseen
and has probability one; very long texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, text_or_empty

ORDER, BACKOFF, POWER = 3, 0.95, 0.2
PART, SHARD = 8_000_000, 16_000_000  # characters
FEW = 64  # numbers that are sent as they are
SPARE = 20
RUN = 1 << 22  # bytes of a text that are split into words at a time
BEGIN, END = np.array([xxhash.xxh64_intdigest(x) for x in (b" ", b"\n")], np.uint64)  # of texts that are no words
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
ASKED = "part long, n int, shard long, keys binary, counts binary"
TOLD = "part long, n int, shard long, counts binary"
SUMS = ("tokens", "words", "once", "twice")
SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Totals:
    tokens: int
    distinct: int
    discount: float  #: of unigram counts

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the base score's ratios."""
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; all unseen words are one outcome."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.distinct) / self.tokens


def backoff(c: np.ndarray) -> np.ndarray:
    """What contexts leave to their shorter ones, by how often training texts go on from them."""
    return BACKOFF * np.maximum(c, 1.0) ** -POWER


def discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)


def hashed(text: str) -> list[np.ndarray]:
    """The beginning, the hash of each word, and the end token."""
    raw, digest, found, at = text.encode().lower(), xxhash.xxh64_intdigest, [np.array([BEGIN])], 0
    while at < len(raw):
        end = at + RUN
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        words = raw[at:end].split()  # bytes split at ASCII white space
        found.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        at = end
    return [*found, np.array([END])]


def path_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols one after the other, and where each text begins."""
    symbols, sizes = [], []
    for text in texts:
        found = hashed(text)
        symbols += found
        sizes.append(sum(map(len, found)))
    return np.concatenate(symbols), np.cumsum([0, *sizes])[:-1]


def after(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams made of a context's hash and a symbol."""
    h = (context * MIX[0]) ^ symbol
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def ngrams(path: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By n: where the n-grams of the path end, and their hashes. A beginning is only a first context."""
    inside = path != BEGIN
    kept = np.uint64((1 << 64) - (1 << (64 - bits)))
    key, ends = path, inside
    for n in range(1, order + 1):
        at = np.flatnonzero(ends)
        yield n, at, key[at] if n == 1 else key[at] & kept
        key = np.concatenate([path[:1], after(key[:-1], path[1:])])
        ends = inside if n == 1 else inside & np.concatenate([[False], ends[:-1]])


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, each compressed apart: high planes are nearly empty, low ones random; a few as they are."""
    if len(numbers) < FEW:
        return numbers.tobytes() + b"\0"
    zipped = zstandard.ZstdCompressor(level=1)
    planes = [zipped.compress(x) for x in np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)]
    return np.array([len(x) for x in planes], "<u4").tobytes() + b"".join(planes) + b"\1"


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    if not blob[-1]:
        return np.frombuffer(blob[:-1], kind)
    size, unzipped = np.dtype(kind).itemsize, zstandard.ZstdDecompressor()
    ends = 4 * size + np.cumsum([0, *np.frombuffer(blob, "<u4", size)])
    planes = [np.frombuffer(unzipped.decompress(blob[a:b]), np.uint8) for a, b in zip(ends[:-1], ends[1:])]
    return np.stack(planes, axis=1).reshape(-1).view(kind)


def asked(part: int, texts: list[str], trains: list[bool], shards: int, order: int, bits: int) -> Iterator[pa.Table]:
    """A part's n-grams by shard: sorted hashes, as differences, and how often training texts hold them; a row for each shard that gets any."""
    path, starts = path_of(texts)
    training = np.repeat(np.array(trains, bool), np.diff([*starts, len(path)]))
    for n, at, key in ngrams(path, order, bits):
        distinct, where = np.unique(key, return_inverse=True)
        counts = np.bincount(where, training[at], len(distinct)).astype("<u4")
        shard = ((distinct >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # ascending, as the hashes are
        named, begins = np.unique(shard, return_index=True)
        keys, sent = np.split(distinct, begins[1:]), np.split(counts, begins[1:])
        keys = [packed(np.diff(k, prepend=np.uint64(0)).astype("<u8")) for k in keys if len(k)]
        columns = {"shard": named.astype(np.int64), "keys": pa.array(keys, pa.binary()), "counts": pa.array([packed(c) for c in sent if len(c)], pa.binary())}
        yield pa.table({"part": pa.array([part] * len(named), pa.int64()), "n": pa.array([n] * len(named), pa.int32())} | columns)


def added(asking: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What each part asks a shard, the counts of the shard's n-grams over all parts, and of which of them each part's are."""
    keys = [np.cumsum(unpacked(k, "<u8"), dtype=np.uint64) for k in asking["keys"].to_pylist()]
    counts = np.concatenate([unpacked(c, "<u4") for c in asking["counts"].to_pylist()])
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(where, counts, len(distinct)).astype(np.int64), where


def told(asking: pa.Table) -> pa.Table:
    """A shard's answers: to each part, the counts over all parts."""
    keys, total, where = added(asking)
    answers = np.split(total.astype("<u8")[where], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({k: asking[k] for k in ("part", "n", "shard")} | {"counts": pa.array(map(packed, answers), pa.binary())})


def summed(asking: pa.Table) -> pa.Table:
    """A shard's share of the totals over words."""
    _, total, _ = added(asking)
    seen = total[total > 0]
    return pa.table({k: [int(v)] for k, v in zip(SUMS, (seen.sum(), len(seen), (seen == 1).sum(), (seen == 2).sum()))})


def totals_of(training: DataFrame, shards: int) -> Totals:
    """Over the words of all training texts, which are counted where they lie and added up by shard; four numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                held.append(text)
                size += len(text)
                if size >= PART:
                    yield from words(held)
                    held, size = [], 0
        if held:
            yield from words(held)

    def words(texts: list[str]) -> Iterator[pa.RecordBatch]:
        for table in asked(0, texts, [True] * len(texts), shards, 1, 64):
            yield from table.to_batches()

    sums = training.select("text").mapInArrow(count, ASKED).groupBy("shard").applyInArrow(summed, ", ".join(f"{c} long" for c in SUMS))
    tokens, distinct, once, twice = (x or 0 for x in sums.agg(*(F.sum(c) for c in SUMS)).first())
    return Totals(tokens, distinct, discount(once, twice))


@dataclass
class Automaton:
    """The arcs and states that some texts can meet, addressed by position of their path.

    arcs[n - 1][number[n - 1][i]] is the weight of the arc for the n-gram that ends at i (nan: there is none);
    fails[n - 1][number[n - 1][i]] the backoff weight of the state that this n-gram is as a context.
    """

    number: list[np.ndarray]
    arcs: list[np.ndarray]
    fails: list[np.ndarray]
    start: int  #: length of the context that a text starts with
    unseen: float  #: what the root gives unseen words

    def traverse(self, begin: int, end: int) -> float:
        """log10 probability of the text whose beginning is at begin."""
        rows = [x[begin:end] for x in self.number]
        arcs = [a[x].tolist() for a, x in zip(self.arcs, rows)]
        fails = [f[x].tolist() for f, x in zip(self.fails, rows)]
        total, state, longest = 0.0, self.start, len(fails)
        for i in range(1, end - begin):
            while (weight := arcs[state][i]) != weight:  # no arc: fail to the shorter context
                if not state:
                    weight = self.unseen
                    state = -1
                    break
                total += fails[state - 1][i - 1]
                state -= 1
            total += weight
            state = state + 1 if state < longest else longest
        return total


def compiled(path: np.ndarray, starts: np.ndarray, counts: list[np.ndarray], totals: Totals, order: int, bits: int) -> tuple[Automaton, np.ndarray]:
    """The automaton, and each position's word count. counts: of the distinct n-grams by n, in their hashes' order."""
    a = Automaton([], [], [], 0, float(np.log10(totals.unigram(np.zeros(1)))[0]))
    shorter_p = shorter_c = word_counts = None
    for n, at, key in ngrams(path, order, bits):
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        c = counts[n - 1].astype(np.float64)
        number = np.full(len(path), -1, np.int32)  # the last entry of what it addresses stands for what isn't there
        if n == 1:
            p = totals.unigram(c)
            number[at] = where
            ends = c[where[-1]]  # every text has one end, and so one beginning
            word_counts = c[where]
            number[starts] = len(c)
            c = np.append(c, ends)
            a.start = int(ends > 0 and order > 1)
            p = np.append(p, np.nan)
        else:
            number[at] = where
            here = at[first]
            context = shorter_c[here - 1]
            left = backoff(context)
            p = (1 - left) * c / np.maximum(context, 1.0) + left * shorter_p[here]
        weight = np.append(np.log10(np.where(c > 0, p, np.nan)), np.nan)
        a.number.append(number)
        a.arcs.append(weight)
        if n < order:
            a.fails.append(np.append(np.log10(backoff(c)), np.nan))
            shorter_p, shorter_c = np.append(p, np.nan)[number], np.append(c, 0.0)[number]
    return a, word_counts


def scored(doc_ids: pa.ChunkedArray, texts: list[str], answers: pa.Table, totals: Totals, order: int, bits: int) -> pa.Table:
    path, starts = path_of(texts)
    answers = answers.sort_by([("n", "ascending"), ("shard", "ascending")])
    ns, blobs = np.array(answers["n"]), answers["counts"].to_pylist()
    counts = [np.concatenate([np.empty(0, "<u8"), *(unpacked(blobs[i], "<u8") for i in np.flatnonzero(ns == n))]) for n in range(1, order + 1)]
    a, c = compiled(path, starts, counts, totals, order, bits)
    ends = np.append(starts[1:], len(path))
    own = starts - np.arange(len(starts))  # where each text begins among the tokens
    found = {
        "n_tokens": ends - starts - 1,
        "n_known": np.add.reduceat((c > 0).astype(np.int64), own),
        "train_tokens": np.full(len(starts), totals.tokens, np.int64),
        "base_score": np.add.reduceat(totals.base(c), own),
        "score": np.array([a.traverse(s, e) for s, e in zip(starts.tolist(), ends.tolist())]),
    }
    return pa.table({"doc_id": doc_ids} | found)


def score(docs: DataFrame, training: Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. training: a condition on doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    size = rows.agg(F.sum(F.length("text") + 1).alias("size")).first()["size"] or 0
    parts, shards = (max(1, math.ceil(size / most)) for most in (PART, SHARD))
    bits = min(64, max(40, SPARE + math.ceil(math.log2(size / 2 + 1))))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    dealt = rows.select(part.alias("part"), "doc_id", "text", F.coalesce(training, F.lit(False)).alias("trains"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return pa.concat_tables(asked(key[0].as_py(), table["text"].to_pylist(), table["trains"].to_pylist(), shards, order, bits))

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        return scored(table["doc_id"], table["text"].to_pylist(), answers, totals, order, bits)

    totals = totals_of(dealt.where("trains"), shards)
    # The texts are exchanged once: both uses of dealt by part are the same exchange.
    answers = dealt.groupBy("part").applyInArrow(ask, ASKED).groupBy("n", "shard").applyInArrow(told, TOLD)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(walk, SCORED)
