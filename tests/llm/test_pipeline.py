"""The pipeline's rows against a plain version of its stages, on a whole table with planted near copies."""

import math
import zlib

import numpy as np
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import clashing, documents, save
from tests.llm.test_near import plain_stay
from tidemark.llm import language, near, toxicity
from tidemark.llm.tokens import vocabulary


def plain_toxic(text, model):
    keep = math.exp(-model.leak)
    for m in toxicity.SENTENCES(text or ""):
        words = toxicity.WORDS(m.group().lower())
        if words:
            z = model.bias + sum(model.weights.get(f, 0) for w in words for f in toxicity.features(w))
            keep *= 1 - 1 / (1 + math.exp(-z))
    return 1 - keep >= 0.5


def plain_accepted(text, model, margin=0.005):
    raw, sizes = language.letters(text or "").encode(), []
    for lang in sorted(model):
        content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=language.LEVEL)
        one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=content, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(one.compress(raw[i : i + language.CHUNK])) for i in range(0, len(raw), language.CHUNK)))
    least, second = sorted(sizes)[:2]
    return bool(raw) and second - least > margin * least


def test_pipeline_by_brute_force(spark, small, tmp_path):
    given = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in given.collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 60][:12]
    # Near copies that lack some words at the end: similarities from 0.8 to 0.98.
    rows += [(100_000 + i, " ".join(t.split()[: len(t.split()) * (82 + i) // 100]), lang, s, n) for i, (_, t, lang, s, n) in enumerate(long)]
    rows += [(200_000, None, "en", "z", 0), (200_001, "", None, "z", 0)]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    folder = save(documents(spark, rows), tmp_path / "tables", labels=labels)

    docs = corpus_pipeline.table(spark, folder, "documents")
    model = toxicity.learn(docs, labels)
    kept = [r for r in rows if not plain_toxic(r[1], model)]
    first = corpus_pipeline.staged(corpus_pipeline.drop_toxic(spark, docs, folder), "one")
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(r[0] for r in kept)
    assert len(kept) < len(rows)

    dictionaries = language.learn(first)
    kept = [r for r in kept if plain_accepted(r[1], dictionaries)]
    second = corpus_pipeline.staged(corpus_pipeline.keep_known_languages(spark, first, folder), "two")
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(r[0] for r in kept)

    stay = plain_stay(kept)
    assert len(stay) < len(kept) - 5
    texts = {r[0]: r[1] for r in kept}
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    covered, used = {}, {}
    for r in corpus_pipeline.run(spark, folder).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids)) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(covered) == stay
    for spans in covered.values():
        assert sum(n for _, n, _ in spans) == spans[0][2] and len({s for s, _, _ in spans}) == len(spans)
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_of_nothing_and_of_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = save(documents(spark, []), tmp_path / "empty", labels=labels)
    assert corpus_pipeline.run(spark, folder).count() == 0
    odd = clashing(documents(spark))
    more = [c for c in ("node", "cells", "first", "carried", "_row", "fp", "sequence_id", "ids_crc32", "lang_pred", "score") if c not in odd.columns]
    odd = odd.selectExpr("*", *(f"'own {c}' as {c}" for c in more))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_known_languages, corpus_pipeline.drop_near_copies):
        kept = stage(spark, odd, folder)
        assert kept.columns == odd.columns
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in more)
    assert corpus_pipeline.pack_documents(spark, odd, folder).where("sequence_id is null").count() == 0


def test_operator_7_s_links_are_candidates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = documents(spark, [(1, text, None, None, 0), (2, text + " end", None, None, 0), (3, text + " " + text, None, None, 0), (4, "other words", None, None, 0)])
    rows = near.sketched(docs.withColumn("id", docs["doc_id"]), ["id"]).drop("carried").distinct()
    pairs = near.within_distance(rows).collect()
    assert pairs and all(r["a"] < r["b"] for r in pairs)
