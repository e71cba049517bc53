"""Operator 10: language identification by compression.

Each language has a raw-content Zstandard dictionary, made of up to SAMPLE distinct labelled texts (those
with the smallest hashes), SHARE letters of each from a place that its hash chooses. A text is lower-cased, reduced to letters, cut into
chunks of CHUNK bytes, and each chunk is compressed with every dictionary; the language with the smallest
total wins. The whole text counts; chunks keep the dictionaries' weight the same from its start to its end.
The bounds of the sample keep a language's dictionary small at any input. Every label is learned; compressors
are made for SLICE languages at a time, so a task's memory does not grow with the labels beyond their content.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text where there
is nothing to learn from; ties go to the language whose name sorts first; equal rows each keep theirs; very long texts count whole; an
empty table gives no rows; other columns are ignored. score is the winner's share under a softmax over
total sizes. accepted is false where the runner-up comes within margin of the winner, and for `und`.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import carried, carried_of, sliced, staged, thinned, with_carried

SAMPLE, SHARE = 160, 600
CHUNK, LEVEL = 6000, 12
SLICE = 64  # languages whose compressors are held at a time
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())  # word characters, as letters are
NON_WORDS, NON_LETTERS = re.compile(r"[\W\d_]+").sub, re.compile(f"[ {re.escape(NUMBERS)}]+").sub
UNKNOWN = "und"


def letters(text: str) -> str:
    kept = NON_WORDS(" ", text.lower()).strip()
    return kept if kept.replace(" ", "").isalpha() else NON_LETTERS(" ", kept).strip()  # few texts hold such numbers


def share_of(text: str, h: int) -> str:
    kept = letters(text)
    at = h % max(len(kept) - SHARE + 1, 1)
    return kept[at : at + SHARE]


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from docs with a text and a lang."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shares = [share_of(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist())]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "text": pa.array(shares, pa.string())})

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    hashed = staged(rows.select("lang", F.xxhash64("text").alias("h")).distinct(), "texts")
    by_lang = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("distinct"))
    sizes = {r["lang"]: r["distinct"] for r in by_lang.collect()}
    ranked = thinned(hashed, "lang", sizes, F.col("h"), SAMPLE).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("k") <= SAMPLE).select("lang", "h")
    texts = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])
    texts = texts.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, text string").groupBy("lang", "h").agg(F.min("text").alias("text"))
    content: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):  # at most SAMPLE rows of SHARE characters a language
        content.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(x).encode() for lang, x in content.items()}


@lru_cache(maxsize=1)
def compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    found = []
    for lang, content in model:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        found.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return found


def total_sizes(text: str, by_language: list) -> list[int]:
    raw = text.encode()
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    return [sum(len(c.compress(x)) for x in chunks) for _, c in by_language]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.005, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score, accepted; with carry also carried, a struct of those columns."""
    model = tuple(sorted(dictionaries.items()))
    slices = [model[i : i + SLICE] for i in range(0, len(model), SLICE)]

    def all_sizes(kept: list[str]) -> list[list[int]]:
        """By text, its total size under each language."""
        sizes: list[list[int]] = [[] for _ in kept]
        for part in slices:
            by_language = compressors(part)
            for text, found in zip(kept, sizes):
                found += total_sizes(text, by_language) if text else []
        return sizes

    def best(sizes: list[int]) -> tuple[str, float, bool]:
        if not sizes:
            return UNKNOWN, 0.0, False
        least = min(sizes)
        score = 1 / sum(math.exp(-min(s - least, 4000) / 8) for s in sizes)
        second = min(sizes[: (at := sizes.index(least))] + sizes[at + 1 :], default=math.inf)
        return model[at][0], score, second - least > margin * least

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [best(s) for s in all_sizes([letters(t) if t else "" for t in batch.column("text").to_pylist()])]
            columns = {k: [f[i] for f in found] for i, k in enumerate(("lang_pred", "score", "accepted"))}
            types = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, t) for (k, v), t in zip(columns.items(), types)} | carried_of(batch))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried(docs, carry))
    return rows.mapInArrow(judge, with_carried(rows, "doc_id long, lang_pred string, score double, accepted boolean"))
