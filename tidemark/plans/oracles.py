"""SQL for the workload's queries: the same results, computed from the same rows by another engine."""

from __future__ import annotations

from tidemark.plans import fixtures as fx

COLS = fx.values(fx.column_rows(), "dataset_urn, ordinal, name, native_type, data_type, nullable")
EDGES = fx.values(fx.edge_rows(), "up_urn, up_path, down_urn, down_path, operation")
TABLE_EDGES = fx.values(fx.table_edge_rows(), "up_urn, down_urn")
ORDERS, CUSTOMERS = fx.urn("orders"), fx.urn("customers")


def changed(kind_of: str = "all") -> str:
    """The catalog after the simulated changes."""
    rename, retype, drop = kind_of in ("all", "rename"), kind_of in ("all", "retype"), kind_of in ("all", "drop")
    name = f"case when dataset_urn = '{ORDERS}' and name = 'order_placed_at' then 'order_created_at' else name end" if rename else "name"
    kind = f"case when dataset_urn = '{ORDERS}' and name = 'gross_amount' then 'VARCHAR(20)' else native_type end" if retype else "native_type"
    where = f"where not (dataset_urn = '{CUSTOMERS}' and name = 'marketing_opt_in')" if drop else ""
    return f"(select dataset_urn, ordinal, {name} as name, {kind} as native_type from {COLS} {where})"


STG_ORDERS = """select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_placed_at, o_orderstatus as order_status,
  cast(o_totalprice as decimal(12,2)) as gross_amount, cast(o_totalprice as decimal(12,2)) as net_amount
  from orders where o_orderstatus <> 'P'"""
STG_ITEMS = """select concat(l_orderkey, '-', l_linenumber) as order_item_id, l_orderkey as order_id, l_partkey as product_id,
  cast(l_quantity as decimal(10,0)) as quantity, cast(l_extendedprice as decimal(12,2)) as unit_price,
  cast(cast(l_quantity as decimal(10,0)) * cast(l_extendedprice as decimal(12,2)) as decimal(22,2)) as line_total
  from lineitem"""
STG_CUSTOMERS = """select c_custkey as customer_id, cast(null as varchar) as email, c_name as full_name, cast(null as date) as signup_date,
  cast(c_nationkey as varchar) as country_code,
  case when c_mktsegment = 'BUILDING' then true when c_mktsegment = 'MACHINERY' then false end as marketing_opt_in from customer"""
STG_PRODUCTS = "select p_partkey as product_id, p_name as sku, p_name as product_name, p_type as category, cast(p_retailprice as decimal(12,2)) as list_price from part"
FCT_ORDERS = f"""select o.order_id, o.customer_id, cast(o.order_placed_at as date) as order_date, o.order_status,
  coalesce(i.item_count, 0) as item_count, o.net_amount as net_revenue
  from ({STG_ORDERS}) o left join (select order_id, count(*) as item_count from ({STG_ITEMS}) group by order_id) i using (order_id)"""


#: Where the three simulated changes begin, and the control column beside the renamed one.
STARTS = [("rename", ORDERS, "order_placed_at"), ("retype", ORDERS, "gross_amount"), ("drop", CUSTOMERS, "marketing_opt_in")]
CONTROL = [("order_placed_at", ORDERS, "order_placed_at"), ("order_status", ORDERS, "order_status")]


def reach(hops: int = 3, starts: list[tuple[str, str, str]] = STARTS) -> str:
    return f"""with recursive e as (select * from {EDGES}), begin as (select * from {fx.values(starts, 'drift, urn, path')}),
reach(drift, urn, path, hops, names, steps) as (
  select drift, urn, path, 0, [path], cast([] as varchar[]) from begin
  union all
  select r.drift, e.down_urn, e.down_path, r.hops + 1, list_append(r.names, e.down_path),
    list_append(r.steps, {short('e.up_urn')} || '.' || e.up_path || '>' || {short('e.down_urn')} || '.' || e.down_path)
  from reach r join e on r.urn = e.up_urn and r.path = e.up_path where r.hops < {hops}
)"""


def day_of(doc_id: str) -> str:
    return f"timestamp '2025-01-01' - to_days(cast({doc_id} % 730 as integer))"


def short(urn: str) -> str:
    """The last part of a dataset's or a job's name."""
    return f"coalesce(nullif(regexp_extract({urn}, 'dataPlatform:[^,]+,(?:[^,]*\\.)?([^,.]+),', 1), ''), nullif(regexp_extract({urn}, ',([^,()]+)\\)$', 1), ''), {urn})"


def name_of(urn: str) -> str:
    return f"regexp_extract({urn}, 'dataPlatform:[^,]+,([^,]+),', 1)"


def removed(old: str, new: str, as_name: str = "name") -> str:
    return f"select dataset_urn, name as {as_name} from {old} where dataset_urn in (select dataset_urn from {new}) and (dataset_urn, name) not in (select (dataset_urn, name) from {new})"


ALL = changed()
GONE, COME = removed(COLS, ALL), removed(ALL, COLS)
FAST = f"""select r.dataset_urn, r.name as old_column, a.name as new_column, 0.95 as confidence
from ({GONE}) r join ({COME}) a using (dataset_urn)
join (select dataset_urn, count(*) as n from ({GONE}) group by 1) nr using (dataset_urn) join (select dataset_urn, count(*) as n from ({COME}) group by 1) na using (dataset_urn)
join {COLS} on t.dataset_urn = r.dataset_urn and t.name = r.name join {ALL} l on l.dataset_urn = r.dataset_urn and l.name = a.name
where nr.n = 1 and na.n = 1 and t.native_type = l.native_type"""
DROPPED = f"select dataset_urn, name as old_column from ({GONE}) g where (dataset_urn, name) not in (select (dataset_urn, old_column) from ({FAST}))"
RETYPED = f"select t.dataset_urn, t.name, t.native_type as old_type, l.native_type as new_type from {COLS} join {ALL} l on t.dataset_urn = l.dataset_urn and t.name = l.name where t.native_type <> l.native_type"
MIXED_B, MIXED_L = (fx.values(x, "dataset_urn, ordinal, name, native_type") for x in (fx.MIXED_BASELINE, fx.MIXED_LIVE))
MIXED_GONE, MIXED_COME = removed(MIXED_B, MIXED_L), removed(MIXED_L, MIXED_B)

PHASE = """case when regexp_matches(event_type, 'detect') then 'detect' when regexp_matches(event_type, 'impact|lineage|schema|quer|search') then 'impact'
when regexp_matches(event_type, 'generate|drop') then 'codegen' when regexp_matches(event_type, 'validate') then 'validate'
when regexp_matches(event_type, 'pull|pr') then 'pr' when regexp_matches(event_type, 'write|incident|tag') then 'writeback' else 'impact' end"""


def as_double(sql: str, columns: str) -> str:
    return f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in columns.split())}) from ({sql})"


def nulls(dataset: str, sql: str) -> str:
    columns = [c for t, c, test in fx.test_rows() if t == dataset and test == "not_null"]
    return " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as failures, '{dataset}' as dataset from ({sql})" for c in columns)


def repeats(dataset: str, column: str, sql: str) -> str:
    return f"select '{column}' as \"column\", count(*) as failures, '{dataset}' as dataset from (select {column} from ({sql}) where {column} is not null group by 1 having count(*) > 1)"


RAW_SQL = {
    "orders": "select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_placed_at, o_orderstatus as order_status, o_totalprice as gross_amount, null as discount_amount, null as currency_code from orders",
    "customers": STG_CUSTOMERS,
    "order_items": STG_ITEMS,
    "products": STG_PRODUCTS,
    "web_events": "select event_id, user_id as session_id, user_id as customer_id, event_type, ts as event_at, props as page_url from events",
}
LTV = f"""select c.customer_id, c.country_code, count(o.order_id) as lifetime_orders, coalesce(sum(o.net_revenue), 0) as lifetime_revenue, min(o.order_date) as first_order_date
from ({STG_CUSTOMERS}) c left join ({FCT_ORDERS}) o on c.customer_id = o.customer_id group by c.customer_id, c.country_code"""

DAILY = f"select order_date, count(*) as order_count, sum(net_revenue) as gross_revenue from ({FCT_ORDERS}) group by order_date"
PERFORMANCE = f"""select p.product_id, p.sku, p.category, coalesce(sum(i.quantity), 0) as units_sold, coalesce(sum(i.line_total), 0) as revenue
from ({STG_PRODUCTS}) p left join ({STG_ITEMS}) i on p.product_id = i.product_id group by 1, 2, 3"""
DIM_CUSTOMERS = f"select customer_id, email, full_name, signup_date, country_code, coalesce(marketing_opt_in, false) as is_marketable from ({STG_CUSTOMERS})"
#: Every dataset of the workload as SQL over the given tables.
DATASETS = RAW_SQL | {
    "stg_orders": STG_ORDERS, "stg_customers": STG_CUSTOMERS, "stg_order_items": STG_ITEMS, "stg_products": STG_PRODUCTS, "stg_web_events": RAW_SQL["web_events"],
    "fct_orders": FCT_ORDERS, "dim_customers": DIM_CUSTOMERS, "dim_products": STG_PRODUCTS, "mart_daily_revenue": DAILY, "mart_customer_ltv": LTV, "mart_product_performance": PERFORMANCE,
}

PATCHED = f"('{fx.urn('stg_orders')}', '{fx.urn('fct_orders')}', '{fx.urn('extract_recent_orders')}')"
DECLARED = fx.values(fx.test_rows(), "dataset, col, test")
#: The buckets and hops of the three published reports.
REPORTED = [
    ("rename", "extract_recent_orders", "REQUIRES_PATCH", 1), ("rename", "fct_orders", "REQUIRES_PATCH", 2), ("rename", "stg_orders", "REQUIRES_PATCH", 1),
    ("rename", "mart_customer_ltv", "DOWNSTREAM_UNAFFECTED", 3), ("rename", "mart_daily_revenue", "DOWNSTREAM_UNAFFECTED", 3),
    ("rename", "dim_customers", "SKIPPED", 3), ("rename", "dim_products", "SKIPPED", 3), ("rename", "mart_product_performance", "SKIPPED", 3),
    ("rename", "stg_customers", "SKIPPED", 2), ("rename", "stg_order_items", "SKIPPED", 2), ("rename", "stg_products", "SKIPPED", 2), ("rename", "stg_web_events", "SKIPPED", 2),
    ("retype", "extract_recent_orders", "REQUIRES_PATCH", 1), ("retype", "stg_orders", "REQUIRES_PATCH", 1),
    ("retype", "fct_orders", "DOWNSTREAM_UNAFFECTED", 2), ("retype", "mart_customer_ltv", "DOWNSTREAM_UNAFFECTED", 3), ("retype", "mart_daily_revenue", "DOWNSTREAM_UNAFFECTED", 3),
    ("retype", "dim_customers", "SKIPPED", 3), ("retype", "dim_products", "SKIPPED", 3), ("retype", "mart_product_performance", "SKIPPED", 3),
    ("retype", "stg_customers", "SKIPPED", 2), ("retype", "stg_order_items", "SKIPPED", 2), ("retype", "stg_products", "SKIPPED", 2), ("retype", "stg_web_events", "SKIPPED", 2),
    ("drop", "dim_customers", "REQUIRES_PATCH", 2), ("drop", "stg_customers", "REQUIRES_PATCH", 1),
    ("drop", "dim_products", "SKIPPED", 3), ("drop", "extract_recent_orders", "SKIPPED", 0), ("drop", "fct_orders", "SKIPPED", 3), ("drop", "mart_customer_ltv", "SKIPPED", 3),
    ("drop", "mart_daily_revenue", "SKIPPED", 3), ("drop", "mart_product_performance", "SKIPPED", 3), ("drop", "stg_order_items", "SKIPPED", 2), ("drop", "stg_orders", "SKIPPED", 2),
    ("drop", "stg_products", "SKIPPED", 2), ("drop", "stg_web_events", "SKIPPED", 2),
]

ORACLES = {
    "stg_orders": as_double(STG_ORDERS, "gross_amount net_amount"),
    "stg_customers": STG_CUSTOMERS,
    "stg_order_items": as_double(STG_ITEMS, "quantity unit_price line_total"),
    "stg_products": as_double(STG_PRODUCTS, "list_price"),
    "stg_web_events": "select event_id, user_id as session_id, user_id as customer_id, event_type, ts as event_at from events",
    "fct_orders": as_double(FCT_ORDERS, "net_revenue"),
    "dim_customers": f"select customer_id, email, full_name, signup_date, country_code, coalesce(marketing_opt_in, false) as is_marketable from ({STG_CUSTOMERS})",
    "dim_products": as_double(STG_PRODUCTS, "list_price"),
    "mart_daily_revenue": as_double(f"select order_date, count(*) as order_count, sum(net_revenue) as gross_revenue from ({FCT_ORDERS}) group by order_date", "gross_revenue"),
    "mart_customer_ltv": as_double(LTV, "lifetime_revenue"),
    "mart_product_performance": as_double(
        f"""select p.product_id, p.sku, p.category, coalesce(sum(i.quantity), 0) as units_sold, coalesce(sum(i.line_total), 0) as revenue
from ({STG_PRODUCTS}) p left join ({STG_ITEMS}) i on p.product_id = i.product_id group by 1, 2, 3""",
        "units_sold revenue",
    ),
    "extract_recent_orders": "select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_placed_at, cast(cast(o_totalprice as decimal(12,2)) as double) as gross_amount from orders where o_orderdate >= timestamp '1998-08-01 00:00:00'",
    "product_catalog": as_double(f"select * from ({STG_PRODUCTS}) where product_id is not null", "list_price"),
    "scan_orders": "select * from orders",
    "catalog_columns": f"select * from {COLS}",
    "list_namespace": f"select distinct {name_of('dataset_urn')} as name from {COLS} where starts_with({name_of('dataset_urn')}, 'shop_prod.analytics.')",
    "captured_queries": f"""with u as (select text, {day_of('doc_id')} as used_at from documents where regexp_matches(text, '(?i)\\bthe\\b')),
latest as (select text, max(used_at) as used_at from u where used_at >= timestamp '2025-01-01' - interval 365 days group by text)
select used_at, length(text) as chars, md5(text) as digest from latest order by used_at desc, md5(text) limit 3""",
    "drift_retype": RETYPED,
    "drift_removed": GONE,
    "drift_added": COME,
    "rename_candidates": f"""select r.dataset_urn, r.name as old_column, a.name as new_column, b.native_type = l.native_type as same_type, b.ordinal = l.ordinal as same_ordinal,
(select count(*) from ({MIXED_GONE}) x where x.dataset_urn = r.dataset_urn) as n_removed, (select count(*) from ({MIXED_COME}) x where x.dataset_urn = r.dataset_urn) as n_added
from ({MIXED_GONE}) r join ({MIXED_COME}) a on r.dataset_urn = a.dataset_urn
join (select * from {MIXED_B}) b on b.dataset_urn = r.dataset_urn and b.name = r.name join (select * from {MIXED_L}) l on l.dataset_urn = r.dataset_urn and l.name = a.name""",
    "drift_rename_fast": FAST,
    "drift_drop": DROPPED,
    "drift_events": f"""select lower(kind) || '-' || regexp_extract({name_of('dataset_urn')}, '[^.]+$') || '-' || coalesce(old_column, new_column) as id, kind, dataset_urn, {name_of('dataset_urn')} as dataset_name, old_column, new_column, old_type, new_type, confidence
from (
  select 'RETYPE' as kind, dataset_urn, name as old_column, name as new_column, old_type, new_type, cast(1 as double) as confidence from ({RETYPED})
  union all select 'RENAME', f.dataset_urn, old_column, new_column, t.native_type, l.native_type, cast(confidence as double) from ({FAST}) f join {COLS} on t.dataset_urn = f.dataset_urn and t.name = old_column join {ALL} l on l.dataset_urn = f.dataset_urn and l.name = new_column
  union all select 'DROP', d.dataset_urn, old_column, null, t.native_type, null, 1 from ({DROPPED}) d join {COLS} on t.dataset_urn = d.dataset_urn and t.name = old_column
)""",
    "schema_diff_rows": f"select dataset_urn, name, o.native_type as old_type, n.native_type as new_type from (select * from {COLS}) o full join {ALL} n using (dataset_urn, name)",
    "column_edges": f"select * from {EDGES}",
    "table_edges": f"select distinct * from {TABLE_EDGES}",
    "column_impact": f"""{reach()}, first as (select drift, urn, path, min(hops) as h from reach group by all),
best as (select r.drift, r.urn, r.hops, r.path, r.names, row_number() over (partition by r.drift, r.urn, r.path order by r.steps) as k from reach r join first f on r.drift = f.drift and r.urn = f.urn and r.path = f.path and r.hops = f.h where r.hops > 0)
select drift, urn, cast(min(hops) as int) as hops, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') as matched_columns from best where k = 1 group by drift, urn""",
    "table_downstreams": f"""with recursive e as (select * from {TABLE_EDGES}), begin as (select * from {fx.values(STARTS, 'drift, urn, path')}), reach(drift, urn, hops) as (
  select drift, urn, 0 from begin union select r.drift, e.down_urn, r.hops + 1 from reach r join e on r.urn = e.up_urn where r.hops < 3)
select drift, urn, cast(min(hops) as int) as hops from reach where (drift, urn) not in (select (drift, urn) from begin) group by drift, urn""",
    "lineage_closure": f"{reach(20)} select distinct drift, urn, path from reach where hops > 0",
    "lineage_paths": f"""{reach()}, best as (select drift, urn, hops, steps, row_number() over (partition by drift, urn order by hops, steps) as k from reach where hops > 0)
select drift, urn, cast(hops as int) as hops, array_to_string(steps, ' ') as steps from best where k = 1""",
    "graph_edges": f"{reach(2)} select distinct r.drift, e.* from e join reach r on e.up_urn = r.urn and e.up_path = r.path",
    "has_outgoing_edge": f"select count(*) > 0 as has_edge from {EDGES} where up_urn = '{fx.urn('mart_customer_ltv')}'",
    "lineage_disagreement": f"{reach(20)} select distinct drift, urn from reach where hops > 1 and (drift, urn) not in (select (drift, urn) from reach where hops = 1)",
    "lineage_control": f"{reach(20, CONTROL)} select distinct urn, drift as reached_by from reach where hops > 0",
    "corrected_edges": f"select up_urn, replace(up_path, 'order_placed_at', 'order_created_at') as up_path, down_urn, replace(down_path, 'order_placed_at', 'order_created_at') as down_path, operation from {EDGES}",
    "documentation_targets": f"select down_urn as urn, coalesce(max(case when down_path = 'order_placed_at' then down_path end), min(down_path)) as \"column\" from {EDGES} where up_path = 'order_placed_at' group by 1",
    "dangling_edges": f"select * from {EDGES} where (up_urn, up_path) not in (select (dataset_urn, name) from {changed('rename')})",
    "consumed_evidence": f"""select down_urn as urn, string_agg('`' || source || '` columns {{' || names || '}}', '; ' order by source) as consumed
from (select down_urn, {short('up_urn')} as source, array_to_string(list_sort(list(distinct up_path)), ', ') as names from {EDGES} group by 1, 2) group by 1""",
    "dq_not_null": " union all ".join(nulls(d, sql) for d, sql in DATASETS.items()),
    "dq_unique": " union all ".join(repeats(d, c, DATASETS[d]) for d, c, test in fx.test_rows() if test == "unique"),
    "writeback_summary": """select event_type as kind, cast(user_id % 20 as varchar) as target, bool_and(value >= 1) as ok, count(*) filter (where value < 1) as failed,
string_agg('event ' || event_id, '; ' order by event_id) filter (where value < 1) as error from events group by 1, 2""",
    "run_events": f"select cast(user_id as varchar) as run_id, row_number() over (partition by user_id order by ts, event_id) as seq, {PHASE} as phase, event_id from events",
    "completed_stages": f"""select run_id, concat_ws(',', case when has_drift then 'detect' end, case when requires_patch is not null then 'impact' end, case when patches > 0 or nothing then 'codegen' end,
case when nothing or (patches > 0 and invalid_patches = 0) then 'validate' end, case when nothing or coalesce(review_ok, false) then 'pr' end, case when actions > 0 and failed_actions = 0 then 'writeback' end) as stages
from (select *, patches = 0 and coalesce(requires_patch, -1) = 0 as nothing from {fx.values(fx.RUNS, ', '.join(x.split()[0] for x in fx.RUN_SCHEMA.split(', ')))})""",
    "live_schema": """select table_name as dataset, cast(ordinal_position as int) as ordinal, column_name as name,
case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') or starts_with(data_type, 'DECIMAL') then 'number' when data_type = 'DATE' then 'date' when starts_with(data_type, 'TIMESTAMP') then 'time' when data_type = 'BOOLEAN' then 'boolean' else 'string' end as data_type
from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""",
    "captured_snapshot": f"select dataset_urn, cast(ordinal as int) as ordinal, name, native_type from {ALL} where contains(dataset_urn, 'dataPlatform:dbt') or dataset_urn = '{ORDERS}'",
    "saved_snapshot": f"select * from {COLS}",
    "flattened_edges": f"select * from {EDGES}",
    "shown_edges": f"{reach(2, STARTS[:1])} select distinct e.* from e join reach r on e.up_urn = r.urn and e.up_path = r.path where e.down_urn in {PATCHED} and (e.up_urn = '{ORDERS}' or e.up_urn in {PATCHED})",
    # The reports' buckets, hops and counts as published.
    "impact_assets": "select scenario, asset, bucket, cast(hops as int) as hops from (values " + ", ".join(f"('{s}', '{a}', '{b}', {h})" for s, a, b, h in REPORTED) + ") as t(scenario, asset, bucket, hops)",
    "impact_stats": "select scenario, cast(p as bigint) as requires_patch, cast(u as bigint) as downstream_unaffected, cast(k as bigint) as skipped, cast(n as bigint) as total_scanned, h as max_hops_reached from (values ('rename', 3, 2, 7, 12, 3), ('retype', 2, 3, 7, 12, 3), ('drop', 2, 0, 10, 12, 3), ('add', 0, 0, 0, 0, 0)) as t(scenario, p, u, k, n, h)",
    "validation_summary": "select scenario, status, source, cast(n as bigint) as n from (values ('rename', 'OK', 'live_catalog', 15), ('rename', 'OK', 'projected_repair', 6), ('rename', 'OK', 'local_cte', 2), ('retype', 'OK', 'live_catalog', 13), ('drop', 'OK', 'live_catalog', 5), ('drop', 'OK', 'projected_repair', 5)) as t(scenario, status, source, n)",
    "validation_gate": "select true as valid",
    "reference_locations": f"select asset_urn, cast(n as bigint) as n_references, lines from (values ('{fx.urn('extract_recent_orders')}', 2, '2,4'), ('{fx.urn('stg_orders')}', 1, '7'), ('{fx.urn('fct_orders')}', 1, '12')) as t(asset_urn, n, lines)",
    "drift_rename_greedy": f"select '{fx.MIXED_BASELINE[0][0]}' as dataset_urn, old_column, new_column, least(0.9, 0.5 * cast(same as int) + 0.4 * ratio + 0.1) as confidence from (values ('placed_at', 'created_at', true, 12.0 / 19), ('customer_email', 'customer_mail', true, 26.0 / 27), ('billing_zip', 'billing_postcode', true, 18.0 / 27)) as t(old_column, new_column, same, ratio)",
    "drift_add": f"select * from (values ('{fx.MIXED_BASELINE[0][0]}', 'new_flag'), ('{fx.MIXED_BASELINE[5][0]}', 'amount_text')) as t(dataset_urn, new_column)",
    "analysis_checks": "select scenario, state, asset, broken is null as ok, broken as object from (select s.scenario, state, asset from (values ('rename'), ('retype'), ('drop')) as s(scenario), (values ('before'), ('after')) as b(state), (values "
    + ", ".join(f"('{a}')" for a in (*fx.MODELS, *fx.EXTRACTS))
    + ") as a(asset)) left join (values ('rename', 'before', 'stg_orders', 'order_placed_at'), ('rename', 'before', 'extract_recent_orders', 'order_placed_at'), ('drop', 'before', 'stg_customers', 'marketing_opt_in')) as f(scenario, state, asset, broken) using (scenario, state, asset)",
    "catalog_consistency": f"select regexp_extract(dataset_urn, '([^.]+),PROD', 1) as model, cast(count(*) as int) as n_columns, true as declared_same, true as traced_same from {COLS} where contains(dataset_urn, 'dataPlatform:dbt') group by 1",
    "docs_renamed": f"""select dataset, if(moved, 'order_created_at', col) as "column", 'The ' || col || if(moved, ' Called `order_placed_at` before a drift repair, `order_created_at` since.', '') as description,
case when not moved then tests when contains(tests, 'not_null') and not contains(tests, 'unique') then tests || ',unique' when contains(tests, 'not_null') then tests else tests || ',not_null' end as tests
from (select dataset, col, string_agg(test, ',' order by test) as tests, col = 'order_placed_at' and dataset not in ('orders') as moved from {DECLARED} group by dataset, col)""",
    "docs_dropped": f"select distinct dataset, col as \"column\" from {DECLARED} where (dataset, col) not in (('stg_customers', 'marketing_opt_in'), ('dim_customers', 'is_marketable'))",
    "generated_tests": "select * from (values ('stg_orders', 'order_created_at', 'not_null'), ('stg_orders', 'order_created_at', 'unique')) as t(dataset, \"column\", test)",
    "run_records": f"select run_id, 'STARTED' as event, null as result from {fx.values(fx.RUNS, ', '.join(x.split()[0] for x in fx.RUN_SCHEMA.split(', ')))} union all select run_id, 'COMPLETE', if(invalid_patches > 0 or failed_actions > 0, 'FAILURE', 'SUCCESS') from {fx.values(fx.RUNS, ', '.join(x.split()[0] for x in fx.RUN_SCHEMA.split(', ')))}",
}
