"""Operators 1, 5, 9 and 10, and the pipeline."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tests.llm.cases import ROWS, clashing, collected, documents, save
from tests.support import duck, same
from tidemark.llm import language, quality, toxicity, url_filters
from tidemark.llm.queries import ORACLE_SQL, QUERIES

TOXIC = "You are a dumb idiot and a loser."
CLEAN = ["The garden is green and quiet today.", "We went to the market for bread.", "It rained all night long."]


def labelled(spark):
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        text = " ".join(CLEAN[(i + k) % 3] for k in range(5)) + (" " + TOXIC if bad else "") + f" Number n{i}."
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(spark)
    return toxicity.learn(docs, labels)


def test_toxic_sentences_are_found(spark, model):
    text = f"{CLEAN[0]} {TOXIC} {CLEAN[1]}"
    docs = documents(spark, [(1, text, None, None, 0), (2, " ".join(CLEAN) * 50, None, None, 0)])
    bad, good = sorted(toxicity.score(docs, model).collect(), key=lambda r: r["doc_id"])
    assert bad["predicted"] == 1 and good["predicted"] == 0 and good["spans"] == []
    (span,) = bad["spans"]
    assert "idiot" in text[span["start"] : span["end"]] and "garden" not in text[span["start"] : span["end"]]


def test_scores_are_the_noisy_or(spark, model):
    text = f"{CLEAN[0]} {TOXIC}"
    got = toxicity.score(documents(spark, [(1, text, None, None, 0)]), model).first()["score"]
    keep = math.exp(-model.leak)
    for m in toxicity.SENTENCES(text):
        z = model.bias + sum(model.weights.get(f, 0) for w in toxicity.WORDS(m.group().lower()) for f in toxicity.features(w))
        keep *= 1 - 1 / (1 + math.exp(-z))
    assert got == pytest.approx(1 - keep)


def test_gradient_descent_lowers_the_loss():
    names = ["x"]
    args = (np.array([1, 1, 0, 0]), np.array([2, 2, 2, 2]), [[0], [1], [], []], [[0], [0], [], []], names, {0: 1.0, 1: 1.0})
    assert toxicity.fit(*args, steps=200).weights["x"] > toxicity.fit(*args, steps=5).weights["x"] > 0


def test_toxicity_of_awkward_documents(spark, model):
    rows = toxicity.score(clashing(documents(spark)), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(documents(spark, []), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score(documents(spark), toxicity.learn(documents(spark), empty)).collect()} == {0}
    odd = spark.createDataFrame([(1, None, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(documents(spark), toxicity.learn(documents(spark), odd)).count() == len(ROWS)


def test_op1_learns_only_from_its_folds(spark, small):
    rows = QUERIES["op1_toxicity"](spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_language(spark, small):
    rows = QUERIES["op10_language"](spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.9
    assert np.mean([r["accepted"] for r in rows]) >= 0.95


def test_language_by_brute_force(spark):
    import zstandard

    docs = documents(spark)
    model = language.learn(docs)
    assert sorted(model) == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.classify(clashing(docs), model).collect()}
    for doc_id, text, *_ in ROWS:
        kept = language.letters(text or "").encode()
        if not kept:
            assert (got[doc_id]["lang_pred"], got[doc_id]["score"], got[doc_id]["accepted"]) == ("und", 0.0, False)
            continue
        sizes = []
        for lang in sorted(model):
            raw = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=language.LEVEL)
            one = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(kept[i : i + language.CHUNK])) for i in range(0, len(kept), language.CHUNK)))
        assert got[doc_id]["lang_pred"] == sorted(model)[sizes.index(min(sizes))]
    nothing = language.learn(documents(spark, []))
    assert {r["lang_pred"] for r in language.classify(docs, nothing).collect()} == {"und"}
    assert language.classify(documents(spark, []), model).count() == 0


def test_numbers_are_no_letters(spark):
    import unicodedata

    every = "".join(map(chr, range(0x110000)))
    kept = set(language.letters(every)) - {" "}
    assert kept == {c for c in every.lower() if unicodedata.category(c)[0] == "L"}
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(["½ ² ① Ⅷ", "٣ 42", "_"])])
    assert {r["lang_pred"] for r in language.classify(docs, {"en": b"the garden"}).collect()} == {"und"}


def plain_counts(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "a b a b a b a b a b", "# ", "é\xa0", " c d e f g h i j k", "\x1c"]), max_size=14).map("".join))
def test_counts(text):
    assert quality.counts(text) == plain_counts(text)


def test_quality_of_awkward_documents(spark):
    rows = quality.judged(clashing(documents(spark))).collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["n_words"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {(2, 0), (3, 0), (4, 0)}
    assert all(r["base_failed"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert quality.judged(documents(spark, [])).count() == 0


def test_hosts_that_mostly_fail_lose_all(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 200 + [("ok", False)] * 150 + [("ok", True)] * 3 + [("tiny", True)]
    frame = spark.createDataFrame(rows, "source string, base_failed boolean")
    got = {r["source"]: r for r in quality.host_verdicts(frame, ["base"]).collect()}
    assert not got["bad"]["host_kept"] and got["good"]["host_kept"] and got["ok"]["host_kept"]
    assert 0 < got["good"]["rate"] < got["ok"]["rate"] < got["tiny"]["rate"] < 1  # shrunk towards the others


def test_op5_drops_the_documents_of_bad_hosts(spark, tmp_path):
    """Through the query, and as its SQL has it: hosts of short texts, of signs, of repeated lines; a small one is spared."""
    words = [f"word{i}" for i in range(400)]
    text = lambda i: " ".join(words[i : i + 30])
    rows = [(i, text(i), None, "fine", 0) for i in range(200)]
    rows += [(1000 + i, text(i) if i % 5 == 0 else "too short", None, "short", 0) for i in range(60)]
    rows += [(2000 + i, text(i) + (" #$%&|<>*" * 5 if i % 4 else ""), None, "signs", 0) for i in range(60)]
    rows += [(3000 + i, text(i) + ("\nread more" * 9 if i % 6 else ""), None, "lines", 0) for i in range(60)]
    rows += [(4000, "too short", None, "tiny", 0), (4001, text(1), None, "tiny", 0), (4002, text(2), None, "tiny", 0), (5000, text(3), None, None, 0)]
    folder = save(documents(spark, rows), tmp_path / "hosts")
    got = QUERIES["op5_quality"](spark, folder)
    same(got, duck(folder).execute(ORACLE_SQL["op5_quality"]).df())
    kept = {r["doc_id"] for r in got.collect() if r["kept"]}
    assert kept == {i for i, *_ in rows if i < 1000} | {4001, 4002, 5000}
    rescued = [r for r in got.collect() if not r["base_failed"] and not r["kept"]]
    assert {r["doc_id"] // 1000 for r in rescued} == {1, 2, 3}  # good texts that go with their host


@pytest.mark.parametrize("name", ["op5_quality", "op8_topk", "op9_url_filters"])
def test_same_as_sql(spark, small, name):
    same(QUERIES[name](spark, small), duck(small).execute(ORACLE_SQL[name]).df())


URLS = [
    (1, "http://Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/"), (4, "http://a.b.example.org/en/2"), (5, None), (6, "example.org/es/"),
    (7, "http://org"), (8, "://org/"), (9, "http://com/de/"), (10, "http://x.com/fr/?q=://"), (11, "http://x.net/de/"), (12, ""), (12, ""), (None, "http://x.org/"), (13, "http://x.org?/es/"), (14, "http://.org/"),
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("example.org", "", "allow"), ("a.b.example.org", "/", "allow")]


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    ends = lambda stops: min([rest.find(c) for c in stops if c in rest], default=len(rest))
    host, path = rest[: ends("/?#")].lower(), rest[ends("/?#") : max(ends("/?#"), ends("?#"))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'e' as host", "'f' as path", "'g' as verdict", "'h' as prefix")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = collected(url_filters.judge(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *plain_verdict(u)) for i, u in URLS), key=repr)
    assert url_filters.judge(pages.where("false"), rules).count() == 0
    none = url_filters.judge(pages, rules.where("false"), "block").collect()
    assert len(none) == len(URLS) and {(r["rule"], r["verdict"]) for r in none} == {(None, "block")}


def test_pipeline_of_awkward_documents(spark, tmp_path):
    docs, labels = labelled(spark)
    folder = save(docs, tmp_path / "a", labels=labels)
    odd = documents(spark, ROWS + [(900, f"{CLEAN[0]} {TOXIC} {TOXIC}", "en", "z", 1)]).unionByName(docs)
    kept = corpus_pipeline.drop_toxic(spark, clashing(odd), folder)
    assert kept.columns == clashing(odd).columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 900 not in ids and {1, 2, 3, 5, 7} <= ids and not any(i in ids for i in range(12, 200, 4))
    known = corpus_pipeline.keep_known_languages(spark, kept, folder)
    assert {2, 3, 4, 8}.isdisjoint(r["doc_id"] for r in known.where("doc_id < 10 and source in ('a', 'b', 'c')").where("text is null or trim(text) = '' or text like '42%'").collect())
    assert known.columns == kept.columns
    single = corpus_pipeline.drop_near_copies(spark, documents(spark), folder)
    got = [r["doc_id"] for r in single.collect()]
    assert got.count(1) == 1 and 6 not in got and None in got and single.columns == documents(spark).columns
    assert len(got) == 7  # texts 2, 3 and 4 are one group, as are 1 and 6


def test_pipeline_runs_to_the_end(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "packing"]
