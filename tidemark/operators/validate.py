"""The gate behind a repair: every column reference of the repaired code must resolve.

References join the tables that their scope names: local tables by their outputs, datasets by the columns
that the repaired models will have, and else by the live catalog. What does not resolve blocks the repair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import references
from tidemark.operators.lineage import cut


def outputs(code: DataFrame) -> DataFrame:
    """asset_urn, scope, name, star: what each select list gives, by its aliases and bare columns."""
    rows = references.placed(code)
    named = rows.where((F.col("prev1") == "as") & F.col("word").rlike("^[A-Za-z_]\\w*$") & (F.col("next1").isin(",", "from", ")")) & ~((F.col("next1") == ")") & F.col("prev3").isin("cast", "(") & F.col("scope").isNull()))
    named = named.where(~F.col("low").isin("date", "decimal", "int", "bigint", "string"))
    item = F.col("word").rlike("^[A-Za-z_]\\w*$") & ~F.col("low").isin(*references.KEYWORDS) & F.col("next1").isin(",", "from")
    bare = rows.where(item & (F.col("prev1").isin("select", ",") | ((F.col("prev1") == ".") & F.col("prev3").isin("select", ","))))
    in_list = rows.where(F.col("word") == "from").groupBy("asset_urn", "scope").agg(F.min("line").alias("until"))
    found = named.unionByName(bare).alias("o").join(in_list.alias("f"), (F.col("o.asset_urn") == F.col("f.asset_urn")) & F.col("o.scope").eqNullSafe(F.col("f.scope")) & (F.col("line") <= F.col("until")))
    return found.select("o.asset_urn", "o.scope", F.col("word").alias("name")).distinct()


def stars(code: DataFrame) -> DataFrame:
    """asset_urn, scope, source: local tables and subqueries that pass all columns of another table on."""
    rows = references.placed(code)
    star = rows.where((F.col("word") == "*") & (F.col("prev1") == "select") & (F.col("next1") == "from"))
    return star.select("asset_urn", "scope", F.when(F.col("next2") == "(", references.subquery(F.col("n") + 3)).otherwise(F.col("next2")).alias("source"))


def checks(code: DataFrame, catalog: DataFrame, patched: DataFrame, inputs: DataFrame, kind: str, drift_urn: str, old: str) -> DataFrame:
    """asset, line, table, column, status, source of each reference of the patched assets' code.

    code: the repaired lines. catalog: the live columns. patched: asset_urn of the files of the repair.
    inputs: input (as code names it in braces), dataset_urn.
    """
    code = cut(references.placed(code.join(patched.select("asset_urn").distinct(), "asset_urn", "left_semi")))
    refs = references.find(code).withColumn("ref", F.monotonically_increasing_id())
    tables = references.tables(code)
    passed = stars(code)
    # A local table that passes another on is that other one.
    through = passed.select("asset_urn", F.col("scope").alias("target"), F.col("source").alias("behind")).where("target is not null")
    tables = tables.join(through, ["asset_urn", "target"], "left").withColumn("target", F.coalesce("behind", "target")).drop("behind")
    named = inputs.select(F.concat(F.lit("{"), "input", F.lit("}")).alias("target"), "dataset_urn")
    tables = tables.join(named, "target", "left")

    projected = outputs(code).where("scope is null").select(F.col("asset_urn").alias("dataset_urn"), "name").where(F.col("dataset_urn").contains("dataPlatform:dbt"))
    live = catalog.select("dataset_urn", "name").join(projected.select("dataset_urn").distinct(), "dataset_urn", "left_anti")
    known = projected.withColumn("source", F.lit("projected_repair")).unionByName(live.withColumn("source", F.lit("live_catalog")))
    known = known.select(F.col("dataset_urn").alias("k_urn"), F.lower("name").alias("k_name"), "source").distinct()
    local = outputs(code).where("scope is not null").select(F.col("asset_urn").alias("l_asset"), F.col("scope").alias("l_table"), F.lower("name").alias("l_name"), F.lit(True).alias("is_local"))

    seen = tables.withColumnRenamed("scope", "outer").alias("s").join(references.visible(code).alias("v"), (F.col("s.asset_urn") == F.col("v.asset_urn")) & F.col("s.outer").eqNullSafe(F.col("v.outer")))
    t, r = seen.select("s.asset_urn", "v.scope", "s.alias", "s.target", "s.dataset_urn", "v.distance").alias("t"), refs.alias("r")
    same = (F.col("t.asset_urn") == F.col("r.asset_urn")) & F.col("t.scope").eqNullSafe(F.col("r.scope")) & (F.col("r.qualifier").isNull() | (F.lower("r.qualifier") == F.col("t.alias")))
    met = r.join(t, same, "left").select("r.*", "t.target", "t.dataset_urn", "t.distance")
    met = met.join(known, (F.col("dataset_urn") == F.col("k_urn")) & (F.lower("name") == F.col("k_name")), "left")
    met = met.join(local, (F.col("asset_urn") == F.col("l_asset")) & (F.col("target") == F.col("l_table")) & (F.lower("name") == F.col("l_name")), "left")
    has_schema = catalog.select(F.col("dataset_urn").alias("s_urn")).distinct().withColumn("has_schema", F.lit(True))
    met = met.join(has_schema, F.col("dataset_urn") == F.col("s_urn"), "left")

    stale = F.lit(kind in ("RENAME", "DROP")) & (F.lower("name") == old.lower()) & (F.col("dataset_urn") == drift_urn)
    is_known = F.col("is_local").isNotNull() | F.col("source").isNotNull()
    # The nearest scope that has the table or the column is the one meant.
    nearest = F.min(F.when(is_known | stale | F.col("qualifier").isNotNull(), F.col("distance"))).over(Window.partitionBy("ref"))
    met = met.withColumn("nearest", nearest).where("nearest is null or distance is null or distance <= nearest")
    one = met.groupBy("ref", "asset", "line", "name").agg(
        F.count("target").alias("tables"),
        F.count_if(F.col("target").startswith("{") & F.col("has_schema").isNull()).alias("unknown_tables"),
        F.count_if(stale).alias("stale"),
        F.min(F.when(is_known, F.coalesce(F.when(F.col("is_local"), F.concat(F.lit("CTE "), "target")), F.col("dataset_urn")))).alias("table"),
        F.min(F.when(is_known, F.when(F.col("is_local"), "local_cte").otherwise(F.col("source")))).alias("source"),
    )
    status = (
        F.when(F.col("tables") == 0, "UNKNOWN_TABLE")
        .when((F.col("unknown_tables") > 0) & F.col("source").isNull(), "UNKNOWN_TABLE")
        .when((F.col("stale") > 0) & (F.coalesce("source", F.lit("")) != "local_cte"), "STALE_OLD_NAME")
        .when(F.col("source").isNull(), "UNKNOWN_COLUMN")
        .otherwise("OK")
    )
    return one.select("asset", "line", "table", F.col("name").alias("column"), status.alias("status"), F.when(status == "OK", F.col("source")).otherwise("unresolved").alias("source"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))


def gate(checked: DataFrame) -> DataFrame:
    """valid: whether all resolve; with nothing to check they do."""
    return checked.agg(F.coalesce(F.bool_and(F.col("status") == "OK"), F.lit(True)).alias("valid"))
