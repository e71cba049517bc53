"""The second gate: Spark analyses each statement over empty tables of the live columns.

The table of references (operators.references) knows a narrow grammar, that of select lists with aliases,
local tables and joins. Here Spark's own analyser resolves the whole statement, whatever it is made of; no
row is read. Statements are analysed in the order given, each model's outputs being the schema that later
ones read; where a statement fails, later ones read its declared columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshot import spark_type

RESULT = "asset string, ok boolean, condition string, object string"


def statements(code: DataFrame) -> dict[str, str]:
    """The text of each asset, as code lines hold it."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return {r["asset"]: r["sql"] for r in code.groupBy("asset").agg(F.array_join(lines, "\n").alias("sql")).collect()}


def empty_tables(spark: SparkSession, columns: DataFrame, inputs: DataFrame) -> dict[str, DataFrame]:
    """By input name, an empty table of its live columns. inputs: input, dataset_urn."""
    typed = columns.join(inputs, "dataset_urn").withColumn("type", spark_type(F.col("native_type")))
    fields = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name", "type"))), lambda x: F.concat(x["name"], F.lit(" "), x["type"]))
    schemas = typed.groupBy("input").agg(F.array_join(fields, ", ").alias("schema")).collect()  # a row for each dataset
    return {r["input"]: spark.createDataFrame([], r["schema"]) for r in schemas}


def analysed(spark: SparkSession, code: DataFrame, columns: DataFrame, inputs: DataFrame, order: Sequence[str], parameters: dict[str, str] | None = None) -> DataFrame:
    """asset, ok, condition, object: whether Spark resolves each statement, else its error and the name at fault."""
    tables, texts, rows = empty_tables(spark, columns, inputs), statements(code), []
    for asset in order:
        sql = texts[asset]
        for name, value in (parameters or {}).items():
            sql = sql.replace(name, value)
        named = set(re.findall(r"\{(\w+)\}", sql))
        if unknown := sorted(named - tables.keys()):
            rows.append((asset, False, "TABLE_OR_VIEW_NOT_FOUND", unknown[0]))
            continue
        try:
            tables[asset] = spark.createDataFrame([], spark.sql(sql, **{n: tables[n] for n in named}).schema)
            rows.append((asset, True, None, None))
        except (AnalysisException, ParseException) as error:
            rows.append((asset, False, error.getCondition(), (error.getMessageParameters() or {}).get("objectName", "").replace("`", "") or None))
    return spark.createDataFrame(rows, RESULT)
