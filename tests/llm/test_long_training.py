"""Toxicity learns from whole texts, however long."""

from tests.llm.cases import documents
from tests.llm.test_judges import CLEAN, TOXIC
from tidemark.llm import toxicity


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    long = " ".join(CLEAN * 2700)  # 51,300 words
    rows = [(i, f"{long} {TOXIC}" if i < 12 else long if i < 24 else " ".join(CLEAN), "en", "a", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 12)) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(documents(spark, rows), labels)
    tests = [(1, f"{CLEAN[0]} {TOXIC}", None, None, 0), (2, f"{long} {TOXIC}", None, None, 0), (3, long, None, None, 0), (4, CLEAN[1], None, None, 0)]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, tests), model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    (span,) = got[2]["spans"]
    assert "idiot" in tests[1][1][span["start"] : span["end"]]
