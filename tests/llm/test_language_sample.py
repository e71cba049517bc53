"""Language ID learns every label, and from all of a text."""

import random

from tests.llm.cases import documents
from tidemark.llm import language

HEAD = "Licence terms apply to all of this. " * 30  # longer than a text's share


def test_dictionaries_reach_beyond_a_shared_beginning(spark):
    body = {"en": "the garden is green and quiet today ", "fr": "le jardin est vert et calme ce soir "}
    docs = documents(spark, [(i, HEAD + body[lang] * 60 + "x" * i, lang, "a", 0) for i in range(20) for lang in body])
    model = language.learn(docs)
    assert b"garden" in model["en"] and b"jardin" in model["fr"]
    tests = documents(spark, [(1, body["en"] * 3, None, None, 0), (2, body["fr"] * 3, None, None, 0)])
    assert {r["doc_id"]: r["lang_pred"] for r in language.classify(tests, model).collect()} == {1: "en", 2: "fr"}


def test_every_label_is_learned(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=100)), f"l{i:03}", "a", 0) for i in range(300)]
    docs = documents(spark, rows)
    model = language.learn(docs)
    assert len(model) == 300
    some = documents(spark, rows[::60])
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(some, model).collect()}
    assert got == {r[0]: r[2] for r in rows[::60]}
