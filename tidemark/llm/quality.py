"""Operator 5: quality rules by document and by host.

Each text gets counts and the rules of RULES. A rule's failures are summed by host (the column source), a
beta prior is fitted to the hosts' rates of that rule by the method of moments, each rate is shrunk towards
it, and hosts where the shrunk rate of some rule reaches max_rate lose their documents: a text that fails the
base rules goes by itself, one that fails the others goes with its host. A host of few documents is judged
mostly by the prior. Sums by host combine before the shuffle, so a host with a third of all rows costs no
more than another. Host verdicts join back by equi-join; Spark broadcasts them only where it measures that
they are small, and splits a hot host otherwise.

Defined results: a null or empty text has no words and fails the base rules alone; null hosts are one host of
their own; equal rows each keep theirs; very long texts are counted whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, staged, text_or_empty

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
#: What a host is judged by: the base rules, a tenth of the characters signs, a tenth as many repeated lines as words, words of odd length.
RULES = {
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "signs": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > n_words",
    "lengths": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words which the text has twice or more.

    Windows of one, two, four and eight words are numbered in turn, each from two of the last size.
    """
    index = dict.fromkeys(words)
    if len(words) <= WINDOW or len(index) == len(words):
        return 0
    for i, w in enumerate(index):
        index[w] = i
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    for step in (1, 2, 4):
        pairs = ids[:-step] * len(words) + ids[step:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space, which is what separates words
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(words), len(b"".join(words).decode()), n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, the counts, and by rule whether it failed."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([counts(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            columns = {k: pa.array(found[:, i]) for i, k in enumerate(COUNTS)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "source": batch.column("source")} | columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty())
    rows = rows.mapInArrow(measure, "doc_id long, source string, " + ", ".join(f"{k} long" for k in COUNTS))
    return rows.select("*", *(F.expr(rule).alias(f"{name}_failed") for name, rule in RULES.items()))


def host_verdicts(rows: DataFrame, rules: Sequence[str] = tuple(RULES), max_rate: float = 0.5) -> DataFrame:
    """source, n, and by rule failures and rate (shrunk); rate, the greatest, and host_kept. rows: source and by rule whether it failed."""
    hosts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_failures") for r in rules))
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")]
    for r in rules:
        f = F.col(f"{r}_failures")
        sums += [F.sum(f).alias(r), F.sum(f * (f / F.col("n"))).alias(f"{r}_squares")]
    m = hosts.agg(*sums).first()
    rates = {}
    for r in rules:
        alpha, beta = prior(m["n"] or 0, m[r] or 0, m[f"{r}_squares"] or 0.0, m["hosts"])
        rates[f"{r}_rate"] = (F.col(f"{r}_failures") + alpha) / (F.col("n") + alpha + beta)
    hosts = hosts.withColumns(rates).withColumn("rate", F.greatest(*rates) if len(rates) > 1 else F.col(next(iter(rates))))
    return hosts.withColumn("host_kept", F.col("rate") < max_rate)


def prior(n: int, failures: int, squares: float, hosts: int) -> tuple[float, float]:
    """The beta distribution whose mean and spread are those of the hosts' rates, weighted by size, less what chance alone spreads."""
    if not n:
        return 1.0, 1.0
    mean = failures / n
    between = max(squares / n - mean * mean - hosts * mean * (1 - mean) / n, 1e-6)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def judged(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """doc_id, source, the counts, base_failed, host_rate and kept."""
    rows = staged(measured(docs).withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "quality")
    hosts = host_verdicts(rows, max_rate=max_rate).select("source", F.col("rate").alias("host_rate"), "host_kept")
    joined = rows.join(hosts, "source")
    source = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return joined.select("doc_id", source.alias("source"), *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
