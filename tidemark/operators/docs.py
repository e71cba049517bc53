"""Schema documentation as rows (dataset, column, description, tests), edited as a repair goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def renamed(docs: DataFrame, datasets: DataFrame, old: str, new: str) -> DataFrame:
    """The entry of a renamed column under its new name, with a note and one more test: not_null, or unique where it has that."""
    here = F.col("_here") & (F.col("column") == old)
    marked = docs.join(datasets.select("dataset").distinct().withColumn("_here", F.lit(True)), "dataset", "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    note = f"Called `{old}` before a drift repair, `{new}` since."
    said = F.trim(F.concat(F.rtrim(F.coalesce("description", F.lit(""))), F.lit(" "), F.lit(note)))
    tests = F.coalesce("tests", F.array().cast("array<string>"))
    more = F.when(~F.array_contains(tests, "not_null"), F.array_append(tests, F.lit("not_null"))).when(~F.array_contains(tests, "unique"), F.array_append(tests, F.lit("unique"))).otherwise(tests)
    edits = {
        "column": F.when(here, F.lit(new)).otherwise(F.col("column")),
        "description": F.when(here & ~F.contains(F.coalesce("description", F.lit("")), F.lit(note)), said).otherwise(F.col("description")),
        "tests": F.when(here, more).otherwise(F.col("tests")),
    }
    return marked.select(*(edits[c].alias(c) if c in edits else c for c in docs.columns))


def dropped(docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Docs without the entries of outputs (dataset, column); case doesn't count."""
    gone = outputs.select(F.col("dataset").alias("_d"), F.lower("column").alias("_c")).distinct()
    return docs.join(gone, (F.col("dataset") == F.col("_d")) & (F.lower("column") == F.col("_c")), "left_anti")


def generated_tests(before: DataFrame, after: DataFrame) -> DataFrame:
    """dataset, column, test: the tests that a repair added."""
    each = lambda d: d.select("dataset", "column", F.explode("tests").alias("test"))
    return each(after).join(each(before), ["dataset", "column", "test"], "left_anti").distinct()
