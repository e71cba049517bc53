"""The workload's declared metadata as rows: columns, lineage edges, jobs, code lines, quality tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.models import EXTRACTS, MODELS, inputs

#: Column names, native types and whether they may be null.
RAW_COLUMNS = {
    "orders": [
        ("order_id", "NUMBER(38,0)", False),
        ("customer_id", "NUMBER(38,0)", False),
        ("order_placed_at", "TIMESTAMP_NTZ", False),
        ("order_status", "VARCHAR(32)", False),
        ("gross_amount", "NUMBER(12,2)", False),
        ("discount_amount", "NUMBER(12,2)", True),
        ("currency_code", "VARCHAR(3)", False),
    ],
    "customers": [
        ("customer_id", "NUMBER(38,0)", False),
        ("email", "VARCHAR(255)", False),
        ("full_name", "VARCHAR(255)", False),
        ("signup_date", "DATE", False),
        ("country_code", "VARCHAR(2)", False),
        ("marketing_opt_in", "BOOLEAN", False),
    ],
    "order_items": [
        ("order_item_id", "NUMBER(38,0)", False),
        ("order_id", "NUMBER(38,0)", False),
        ("product_id", "NUMBER(38,0)", False),
        ("quantity", "NUMBER(10,0)", False),
        ("unit_price", "NUMBER(12,2)", False),
    ],
    "products": [
        ("product_id", "NUMBER(38,0)", False),
        ("sku", "VARCHAR(64)", False),
        ("product_name", "VARCHAR(255)", False),
        ("category", "VARCHAR(64)", False),
        ("list_price", "NUMBER(12,2)", False),
    ],
    "web_events": [
        ("event_id", "VARCHAR(64)", False),
        ("session_id", "VARCHAR(64)", False),
        ("customer_id", "NUMBER(38,0)", True),
        ("event_type", "VARCHAR(32)", False),
        ("event_at", "TIMESTAMP_NTZ", False),
        ("page_url", "VARCHAR(1024)", False),
    ],
}
#: Outputs that are not the same column of a model's first input: output, type, whether it may be null, operation, upstreams.
DERIVED = {
    "stg_orders": [
        ("net_amount", "NUMBER(12,2)", False, "ARITHMETIC", ["orders.gross_amount", "orders.discount_amount"]),
    ],
    "stg_order_items": [
        ("line_total", "NUMBER(22,2)", False, "ARITHMETIC", ["order_items.quantity", "order_items.unit_price"]),
    ],
    "fct_orders": [
        ("order_date", "DATE", False, "CAST_DATE", ["stg_orders.order_placed_at"]),
        ("item_count", "NUMBER(38,0)", False, "COUNT", ["stg_order_items.order_id"]),
        ("net_revenue", "NUMBER(12,2)", False, "IDENTITY", ["stg_orders.net_amount"]),
    ],
    "dim_customers": [
        ("is_marketable", "BOOLEAN", False, "IDENTITY", ["stg_customers.marketing_opt_in"]),
    ],
    "mart_daily_revenue": [
        ("order_count", "NUMBER(38,0)", False, "COUNT", ["fct_orders.order_id"]),
        ("gross_revenue", "NUMBER(18,2)", False, "SUM", ["fct_orders.net_revenue"]),
    ],
    "mart_customer_ltv": [
        ("lifetime_orders", "NUMBER(38,0)", False, "COUNT", ["fct_orders.order_id"]),
        ("lifetime_revenue", "NUMBER(18,2)", False, "SUM", ["fct_orders.net_revenue"]),
        ("first_order_date", "DATE", True, "MIN", ["fct_orders.order_date"]),
    ],
    "mart_product_performance": [
        ("units_sold", "NUMBER(38,0)", False, "SUM", ["stg_order_items.quantity"]),
        ("revenue", "NUMBER(18,2)", False, "SUM", ["stg_order_items.line_total"]),
    ],
}
#: Outputs in their order, where a model doesn't keep all columns of its first input followed by the derived ones.
OUTPUTS = {
    "stg_orders": ["order_id", "customer_id", "order_placed_at", "order_status", "gross_amount", "net_amount"],
    "stg_web_events": ["event_id", "session_id", "customer_id", "event_type", "event_at"],
    "fct_orders": ["order_id", "customer_id", "order_date", "order_status", "item_count", "net_revenue"],
    "dim_customers": ["customer_id", "email", "full_name", "signup_date", "country_code", "is_marketable"],
    "mart_daily_revenue": ["order_date", "order_count", "gross_revenue"],
    "mart_customer_ltv": ["customer_id", "country_code", "lifetime_orders", "lifetime_revenue", "first_order_date"],
    "mart_product_performance": ["product_id", "sku", "category", "units_sold", "revenue"],
}
#: What each job reads and writes; only the first has code of its own.
STAGING, MARTS = [m for m in MODELS if m.startswith("stg_")], [m for m in MODELS if not m.startswith("stg_")]
JOBS = {"extract_recent_orders": (["orders"], []), "run_dbt_staging": (list(RAW_COLUMNS), STAGING), "run_dbt_marts": (STAGING, MARTS)}
CODE_JOBS = ["extract_recent_orders"]
#: Logical types by the word that a native type starts with.
LOGICAL = {"NUMBER": "number", "VARCHAR": "string", "DATE": "date", "TIMESTAMP_NTZ": "time", "BOOLEAN": "boolean"}


def urn(name: str) -> str:
    if name in JOBS:
        return f"urn:li:dataJob:(urn:li:dataFlow:(airflow,shopflow_daily,PROD),{name})"
    platform, schema = ("snowflake", "raw") if name in RAW_COLUMNS else ("dbt", "analytics")
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},shop_prod.{schema}.{name},PROD)"


def definitions() -> dict[str, list[tuple[str, str, bool]]]:
    """Columns, types and nullability of each dataset, in order."""
    found = {k: list(v) for k, v in RAW_COLUMNS.items()}
    for model, sql in MODELS.items():
        known = {x[0]: x for x in found[inputs(sql)[0]]} | {x[0]: x[:3] for x in DERIVED.get(model, [])}
        found[model] = [known[n] for n in OUTPUTS.get(model, known)]
    return found


def column_rows() -> list[tuple]:
    """dataset_urn, ordinal, name, native_type, data_type, nullable."""
    return [
        (urn(d), i, name, kind, LOGICAL[kind.split("(")[0]], nullable)
        for d, columns in definitions().items()
        for i, (name, kind, nullable) in enumerate(columns, 1)
    ]


def edge_rows() -> list[tuple]:
    """up_urn, up_path, down_urn, down_path, operation."""
    rows = []
    for model, sql in MODELS.items():
        own = {x[0]: x[3:] for x in DERIVED.get(model, [])}
        for name, *_ in definitions()[model]:
            operation, ups = own.get(name, ("IDENTITY", [f"{inputs(sql)[0]}.{name}"]))
            rows += [(urn(u.split(".")[0]), u.split(".")[1], urn(model), name, operation) for u in ups]
    return rows


def table_edge_rows() -> list[tuple]:
    """up_urn, down_urn: models on what they read, jobs on what they read, what jobs write on them."""
    rows = [(urn(i), urn(m)) for m, sql in MODELS.items() for i in inputs(sql)]
    for job, (reads, writes) in JOBS.items():
        rows += [(urn(x), urn(job)) for x in reads] + [(urn(job), urn(x)) for x in writes]
    return rows


def code_rows() -> list[tuple]:
    """asset_urn, asset, kind, line, text; inputs stand as {name}. A job's text starts after the line that opens its constant."""
    rows = [(urn(m), m, "dbt_model", i, line) for m, sql in MODELS.items() for i, line in enumerate(sql.splitlines(), 1)]
    return rows + [(urn(j), j, "airflow_task", i, line) for j in CODE_JOBS for i, line in enumerate(EXTRACTS[j].splitlines(), 2)]


def test_rows() -> list[tuple]:
    """dataset, column, test: not null where declared so, unique for keys."""
    rows = []
    for d, columns in definitions().items():
        rows += [(d, name, "not_null") for name, _, nullable in columns if not nullable]
    keys = {"orders": "order_id", "customers": "customer_id", "order_items": "order_item_id", "products": "product_id", "web_events": "event_id", "mart_daily_revenue": "order_date", "mart_customer_ltv": "customer_id", "mart_product_performance": "product_id"}
    for d in definitions():
        stem = d.split("_", 1)[1] if d[:4] in ("stg_", "fct_", "dim_") else d
        rows.append((d, keys[stem], "unique"))
    rows += [(d, "sku", "unique") for d in ("products", "stg_products", "dim_products")]
    return rows


COLUMNS = "dataset_urn string, ordinal int, name string, native_type string, data_type string, nullable boolean"
EDGES = "up_urn string, up_path string, down_urn string, down_path string, operation string"
TABLE_EDGES = "up_urn string, down_urn string"
CODE = "asset_urn string, asset string, kind string, line int, text string"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a table whose size Spark knows, in one partition: what reads only such tables needs no shuffle."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = ", ".join(f"cast({n} as {t}) as {n}" for n, t in fields)
    return spark.sql(f"select {columns} from values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} as t({', '.join(n for n, _ in fields)})").coalesce(1)


def catalog_columns(spark: SparkSession) -> DataFrame:
    return local(spark, column_rows(), COLUMNS)


def column_edges(spark: SparkSession) -> DataFrame:
    return local(spark, edge_rows(), EDGES)


def table_edges(spark: SparkSession) -> DataFrame:
    return local(spark, table_edge_rows(), TABLE_EDGES)


def code_lines(spark: SparkSession) -> DataFrame:
    return local(spark, code_rows(), CODE)


def values(rows: list[tuple], names: str) -> str:
    """Rows as an SQL table expression, for oracles."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as t({names})"

#: Snapshots of a made-up dataset where several columns come and go at once, and of one where one does.
_M, _O = urn("orders").replace("orders", "mixed"), urn("orders").replace("orders", "single")
MIXED_BASELINE = [
    (_M, 1, "id", "NUMBER(38,0)"), (_M, 2, "placed_at", "TIMESTAMP_NTZ"), (_M, 3, "customer_email", "VARCHAR(255)"), (_M, 4, "billing_zip", "VARCHAR(16)"), (_M, 5, "legacy", "BOOLEAN"),
    (_O, 1, "id", "NUMBER(38,0)"), (_O, 2, "amount", "NUMBER(12,2)"),
]
MIXED_LIVE = [
    (_M, 1, "id", "NUMBER(38,0)"), (_M, 2, "created_at", "TIMESTAMP_NTZ"), (_M, 3, "customer_mail", "VARCHAR(255)"), (_M, 4, "billing_postcode", "VARCHAR(16)"), (_M, 5, "new_flag", "BOOLEAN"),
    (_O, 1, "id", "NUMBER(38,0)"), (_O, 2, "amount_text", "VARCHAR(20)"),
]
#: Runs as their artifacts stand: nothing yet, refused after impact, nothing to repair, repaired, one action failed.
RUN_SCHEMA = "run_id string, has_drift boolean, requires_patch int, patches int, invalid_patches int, review_ok boolean, actions int, failed_actions int"
RUNS = [
    ("r0", False, None, 0, 0, None, 0, 0),
    ("r1", True, None, 0, 0, None, 0, 0),
    ("r2", True, 0, 0, 0, None, 6, 0),
    ("r3", True, 3, 3, 0, True, 6, 0),
    ("r4", True, 3, 3, 1, None, 0, 0),
    ("r5", True, 3, 3, 0, True, 6, 1),
]
