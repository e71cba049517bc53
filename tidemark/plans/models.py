"""The workload's staging models, marts and extracts: SQL text, run by Spark over named inputs.

The text is also the code that impact analysis reads (plans.fixtures.code_lines). A name in braces is an
input: a raw table or another model. Staging models are views and marts are tables where they are saved.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.warehouse import RAW, raw


#: The workload's statements; the reports' reference counts and line numbers rest on their text.
MODELS = {
    "stg_orders": """with source as (
    select * from {orders}
)
select
    order_id,
    customer_id,
    order_placed_at,
    order_status,
    gross_amount,
    gross_amount - coalesce(discount_amount, 0) as net_amount
from source
where order_status <> 'P'
""",
    "stg_customers": """with source as (
    select * from {customers}
)
select
    customer_id,
    email,
    full_name,
    signup_date,
    country_code,
    marketing_opt_in
from source
""",
    "stg_order_items": """with source as (
    select * from {order_items}
)
select
    order_item_id,
    order_id,
    product_id,
    quantity,
    unit_price,
    quantity * unit_price as line_total
from source
""",
    "stg_products": """with source as (
    select * from {products}
)
select
    product_id,
    sku,
    product_name,
    category,
    list_price
from source
""",
    "stg_web_events": """with source as (
    select * from {web_events}
)
select
    event_id,
    session_id,
    customer_id,
    event_type,
    event_at
from source
""",
    "fct_orders": """with orders as (
    select * from {stg_orders}
),
items as (
    select order_id, count(*) as item_count
    from {stg_order_items}
    group by order_id
)
select
    o.order_id,
    o.customer_id,
    cast(o.order_placed_at as date) as order_date,
    o.order_status,
    coalesce(i.item_count, 0) as item_count,
    o.net_amount as net_revenue
from orders o
left join items i on o.order_id = i.order_id
""",
    "dim_customers": """select
    customer_id,
    email,
    full_name,
    signup_date,
    country_code,
    coalesce(marketing_opt_in, false) as is_marketable
from {stg_customers}
""",
    "dim_products": """select
    product_id,
    sku,
    product_name,
    category,
    list_price
from {stg_products}
""",
    "mart_daily_revenue": """select
    order_date,
    count(*) as order_count,
    sum(net_revenue) as gross_revenue
from {fct_orders}
group by order_date
""",
    "mart_customer_ltv": """select
    c.customer_id,
    c.country_code,
    count(o.order_id) as lifetime_orders,
    coalesce(sum(o.net_revenue), 0) as lifetime_revenue,
    min(o.order_date) as first_order_date
from {dim_customers} c
left join {fct_orders} o on c.customer_id = o.customer_id
group by c.customer_id, c.country_code
""",
    "mart_product_performance": """select
    p.product_id,
    p.sku,
    p.category,
    coalesce(sum(i.quantity), 0) as units_sold,
    coalesce(sum(i.line_total), 0) as revenue
from {dim_products} p
left join {stg_order_items} i on p.product_id = i.product_id
group by p.product_id, p.sku, p.category
""",
}

#: The two extracts' statements.
EXTRACTS = {
    "extract_recent_orders": """select order_id, customer_id, order_placed_at, gross_amount
from {orders}
where order_placed_at >= dateadd(day, -1, :as_of)
""",
    "product_catalog": """select product_id, sku, product_name, category, list_price
from {products}
where product_id is not null
""",
}


def inputs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def build(spark: SparkSession, sf_dir: str, name: str, as_of: str = "1998-08-02 00:00:00") -> DataFrame:
    """A raw table, model or extract as a DataFrame; what it reads is inlined into one plan."""
    if name in RAW:
        return raw(spark, sf_dir, name)
    sql = (MODELS | EXTRACTS)[name]
    frames = {x: build(spark, sf_dir, x) for x in inputs(sql)}
    return spark.sql(sql.replace(":as_of", f"timestamp_ntz'{as_of}'"), **frames)


def save(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Staging models become temporary views, marts tables."""
    frame = build(spark, sf_dir, name)
    if name.startswith("stg_"):
        frame.createOrReplaceTempView(name)
    else:
        frame.write.mode("overwrite").saveAsTable(name)
