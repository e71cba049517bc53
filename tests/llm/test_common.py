"""Columns of clashing names are carried whole; staging works where no folder is named."""

import os
import subprocess
import sys

from tests.llm.cases import ROWS, collected, documents
from tidemark.llm import language, toxicity

NAMES = ["score", "predicted", "spans", "lang_pred", "accepted", "carried", "_row", "fp"]


def test_carried_columns_clash_with_nothing(spark):
    docs = documents(spark).selectExpr("*", *(f"doc_id + {i} as `{n}`" for i, n in enumerate(NAMES)))
    judges = [
        lambda carry: toxicity.score(docs, toxicity.Model({"idiot": 9.0}, -6.0, 0.01), carry=carry),
        lambda carry: language.classify(docs, {"en": b"the garden", "fr": b"le jardin"}, carry=carry),
    ]
    for judge in judges:
        plain = judge([])
        assert "carried" not in plain.columns and plain.count() == len(ROWS)
        found = judge(docs.columns)
        assert collected(found.select("carried.*"), *docs.columns) == collected(docs, *docs.columns)
        assert collected(found.drop("carried"), "doc_id", "score") == collected(plain, "doc_id", "score")


SCRIPT = """
from pyspark.sql import SparkSession
from tidemark.llm.common import staged
spark = SparkSession.builder.master("local").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = staged(spark.range(3), "a"), staged(spark.range(4), "b")
assert (one.count(), two.count()) == (3, 4)
assert len({f.rsplit("/", 2)[0] for f in one.inputFiles() + two.inputFiles()}) == 1
"""


def test_local_sessions_need_no_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)}  # without the machine's defaults
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=env, check=True, timeout=300)
