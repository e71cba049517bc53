"""A cleaning pipeline over documents: toxicity, language ID, near-dedup, packing.

A null or empty text is judged by the toxicity model's constant term alone and has no language, so language ID
rejects it at the latest. Of a near-duplicate group the row with the smallest doc_id stays (null ids come last),
one of its equals if rows repeat. Very long texts are judged and packed whole. The first three stages keep all
columns, whatever their names; the last returns pieces. Empty tables give no rows; without labels nothing is
toxic, and without known languages nothing passes the second stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, near, packing, toxicity
from tidemark.llm.common import staged, table
from tidemark.llm.tokens import BLANKS_DROPPED, vocabulary

#: SQL can't express the models; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def filtered(docs: DataFrame, judge: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows of docs, with all their columns, whose judgement meets condition; no join back is needed."""
    return judge(docs, docs.columns).where(condition).select("carried.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, trained on the labels of sf_dir, doesn't predict toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return filtered(docs, lambda rows, carry: toxicity.score(rows, model, carry=carry), "predicted = 0")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells by more than the margin, learned from their lang labels."""
    model = language.learn(docs)
    return filtered(docs, lambda rows, carry: language.classify(rows, model, carry=carry), "accepted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    # Plain key columns, so that the join and the removal of repeated rows share one shuffle of the texts.
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # no column of docs begins so
    key = [f"{own}unknown", f"{own}id", f"{own}text"]
    named = docs.withColumns(dict(zip(key, (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")))))
    return named.join(near.firsts(named, key), key, "left_semi").dropDuplicates(key).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), BLANKS_DROPPED, 1, 2048, digest=True)
    return packing.pack(cut, 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
