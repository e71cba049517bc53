"""The workload's raw tables, as views of the driver's Parquet tables.

Money is cast to decimals here, so that sums don't depend on their order. Columns that the Parquet tables
lack are null (discounts, currencies, e-mails) or stand-ins (session ids, page urls).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = {
    "orders": "orders",
    "customers": "customer",
    "order_items": "lineitem",
    "products": "part",
    "web_events": "events",
}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no table {name}.parquet in {sf_dir}; check the folder that was passed") from error


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table by its workload name; only the columns that a query names are read."""
    table = parquet(spark, sf_dir, RAW[name])
    money = lambda c: F.col(c).cast("decimal(12,2)")
    if name == "orders":
        return table.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_placed_at"),
            F.col("o_orderstatus").alias("order_status"),
            money("o_totalprice").alias("gross_amount"),
            F.lit(None).cast("decimal(12,2)").alias("discount_amount"),
            F.lit(None).cast("string").alias("currency_code"),
        )
    if name == "customers":
        return table.select(
            F.col("c_custkey").alias("customer_id"),
            F.lit(None).cast("string").alias("email"),
            F.col("c_name").alias("full_name"),
            F.lit(None).cast("date").alias("signup_date"),
            F.col("c_nationkey").cast("string").alias("country_code"),
            F.expr("case when c_mktsegment = 'BUILDING' then true when c_mktsegment = 'MACHINERY' then false end").alias("marketing_opt_in"),
        )
    if name == "order_items":
        return table.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("decimal(10,0)").alias("quantity"),
            money("l_extendedprice").alias("unit_price"),
        )
    if name == "products":
        return table.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            money("p_retailprice").alias("list_price"),
        )
    return table.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.col("user_id").alias("customer_id"),
        "event_type",
        F.col("ts").alias("event_at"),
        F.col("props").alias("page_url"),
    )
