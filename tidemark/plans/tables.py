"""Registered queries that put events and records through stored tables and streams, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import incident_id
from tidemark.operators import drift, matching, store
from tidemark.sources.shared import new_path, spread
from tidemark.sources.warehouse import parquet
from tidemark.streaming import delivery, events


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a run's log, one run a user, numbered in order of time."""
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), events.phase_of(F.col("event_type")).alias("phase"),
        F.lit("info").alias("level"), F.format_string("%012d", "event_id").alias("title"), F.lit("").alias("detail"), F.col("props").alias("data"),
    )
    return events.number(rows)


def scattered(log: DataFrame) -> tuple[str, int]:
    """A log in which each event stands twice, in an order that its hash tells; its path and how many files it has."""
    spark, path = log.sparkSession, new_path(log.sparkSession, "log")
    twice = log.withColumn("_order", F.explode(F.array(*(F.xxhash64("run_id", "seq", F.lit(i)) for i in range(2)))))
    twice.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order").write.parquet(path)
    return path, len(spark.read.schema(events.SCHEMA).parquet(path).inputFiles())


def delivered(spark: SparkSession, sf_dir: str, after: DataFrame | None = None) -> DataFrame:
    """The scattered log in about eight micro-batches, put in order again."""
    path, files = scattered(run_log(spark, sf_dir))
    found = delivery.deliver(spark, path, new_path(spark, "delivered"), new_path(spark, "state"), after, max(1, -(-files // 8)))
    return found.select("run_id", "position", "seq", F.col("title").cast("long").alias("event_id"), "phase", F.col("skipped"))


def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a log that is out of order and says all twice, once and in order: position counts deliveries."""
    return delivered(spark, sf_dir)


def resumed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a client that has had the first two thirds of every even user's events."""
    users = parquet(spark, sf_dir, "events").where("user_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("run_id"))
    return delivered(spark, sf_dir, users.agg(F.floor(F.count(F.lit(1)) * 2 / 3).alias("after")))


def stored_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's events said last, by type, after three overlapping change sets of which the oldest comes again at the end."""
    kinds = ("click", "error", "signup")
    rows = parquet(spark, sf_dir, "events").select(
        F.lit("events").alias("dataset_urn"), F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("version"),
        *(F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds),
    )
    table = store.notes(new_path(spark, "notes"), dict.fromkeys(kinds, "double"))
    third = F.col("version") % 3
    for some in (third != 2, third != 0, third != 1, third != 2):
        store.merge(spark, table, rows.where(some))
    return store.read(spark, table).drop("dataset_urn")


def stored_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each user's events as tags, put in twice."""
    rows = parquet(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("urn"), F.lit("type").alias("field"), F.col("event_type").alias("tag"))
    table = store.tags(new_path(spark, "tags"))
    store.merge(spark, table, rows.where("urn >= '5'"))
    store.merge(spark, table, rows)
    return store.read(spark, table)


def stored_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident for each user and day with an error; fixed where there is a signup too, which is known before some errors are."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = parquet(spark, sf_dir, "events").select(F.concat(F.lit("drop-"), day).alias("drift"), F.col("user_id").cast("string").alias("dataset_urn"), F.col("event_type").alias("column"), "event_id")
    named = incident_id(F.col("drift"), F.col("dataset_urn"), F.lit("error")).alias("id")
    errors = rows.where("column = 'error'")
    opened = errors.select(named, "drift", "dataset_urn", "column", F.lit("TRIAGE").alias("status"), F.lit(0).alias("version"))
    reviewed = rows.where("column = 'signup'").join(errors.select("drift", "dataset_urn").distinct(), ["drift", "dataset_urn"], "left_semi")
    fixed = reviewed.select(named, F.lit("FIXED").alias("status"), F.lit(1).alias("version"))
    table = store.incidents(new_path(spark, "incidents"))
    for changes in (opened, fixed, opened):
        store.merge(spark, table, changes)
    return store.read(spark, table)


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's addresses without their queries, under the first page's label; later pages are put in before earlier ones."""
    url = F.regexp_extract("url", "^[^?#]*", 0)
    rows = parquet(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("urn"), url.alias("url"), F.concat(F.lit("page "), "page_id").alias("label"), F.col("page_id").alias("version"))
    table = store.links(new_path(spark, "links"))
    for some in (F.col("version") % 2 == 1, F.col("version") % 2 == 0, F.lit(True)):
        store.merge(spark, table, rows.where(some))
    return store.read(spark, table)


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From parts to the suppliers that ship them; then those of some suppliers are only what was returned, replaced twice."""
    items = parquet(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("up_urn"), F.lit("part").alias("up_path"), F.col("l_suppkey").cast("string").alias("down_urn"), F.lit("supplier").alias("down_path"), "l_returnflag")
    shipped = items.drop("l_returnflag").distinct().withColumns({"operation": F.lit("SHIPPED"), "version": F.lit(0)})
    returned = items.where("l_returnflag = 'R'").drop("l_returnflag").distinct().withColumns({"operation": F.lit("RETURNED"), "version": F.lit(1)})
    some = parquet(spark, sf_dir, "supplier").where("s_acctbal < 2500").select(F.col("s_suppkey").cast("string").alias("down_urn"))
    table = store.edges(new_path(spark, "edges"))
    with spread(spark, items.count()):
        store.merge(spark, table, shipped)
        for _ in range(2):
            store.replace(spark, table, some, returned)
    return store.read(spark, table).select("up_urn", "down_urn", "operation")


def part_columns(spark: SparkSession, sf_dir: str, odd: int, named_by_type: bool = True, by_size: bool = False) -> DataFrame:
    """The parts with even or odd keys as columns of one dataset for each brand: named by name and type, at the place of their least size."""
    rows = parquet(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == odd)
    name = [F.replace("p_name", F.lit(" "), F.lit("_")), *([F.lower("p_type")] if named_by_type else [])]
    dataset = [F.replace("p_brand", F.lit("#"), F.lit("")), *([F.lit("_"), F.col("p_size").cast("string")] if by_size else [])]
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:shop,shop.parts."), *dataset, F.lit(",PROD)")).alias("dataset_urn")
    return rows.groupBy(urn, F.concat_ws("_", *name).alias("name")).agg(F.min("p_size").alias("ordinal"), F.min("p_type").alias("native_type"))


def similar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand, names of even parts beside those of odd ones that their letters allow to be alike, and how many letters they share."""
    old, new = (part_columns(spark, sf_dir, odd).select("dataset_urn", "name") for odd in (0, 1))
    return matching.candidates(old, new, ["dataset_urn"], drift.LEAST)


def pruned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand, how many pairs of names there are, and how many of them need to be compared letter by letter."""
    old, new = (part_columns(spark, sf_dir, odd).select("dataset_urn", "name") for odd in (0, 1))
    n = [x.groupBy("dataset_urn").agg(F.count(F.lit(1)).alias(c)) for x, c in ((old, "n_old"), (new, "n_new"))]
    kept = matching.candidates(old, new, ["dataset_urn"], drift.LEAST).groupBy("dataset_urn").agg(F.count(F.lit(1)).alias("compared"))
    both = n[0].join(n[1], "dataset_urn").join(kept, "dataset_urn", "left")
    return both.select("dataset_urn", (F.col("n_old") * F.col("n_new")).alias("pairs"), F.coalesce("compared", F.lit(0)).alias("compared"))


def renamed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames from the even parts' columns to the odd ones', greedily by dataset."""
    found = drift.renamed_greedy(part_columns(spark, sf_dir, 0), part_columns(spark, sf_dir, 1))
    return found.select("dataset_urn", "old_column", "new_column", "similarity", "confidence")


def nearest_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation whose balances are within 500, paired greedily, the nearest first."""
    placed = lambda name, nation, key, balance: parquet(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.col(key).alias("key"), F.round(F.col(balance) * 100).cast("long").alias("at"))
    customers, suppliers = placed("customer", "c_nationkey", "c_custkey", "c_acctbal"), placed("supplier", "s_nationkey", "s_suppkey", "s_acctbal")
    return matching.nearest(customers, suppliers, ["nation"], 50_000).select("nation", F.col("left").alias("customer"), F.col("right").alias("supplier"), "apart")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (delivered_events, resumed_events, stored_notes, stored_tags, stored_incidents, stored_links, stored_edges, similar_candidates, pruned_candidates, renamed_parts, nearest_accounts)
}

# What marks the tools of a phase.
PHASE = """case when regexp_matches(event_type, 'detect') then 'detect' when regexp_matches(event_type, 'impact|lineage|schema|quer|search') then 'impact'
when regexp_matches(event_type, 'generate|drop') then 'codegen' when regexp_matches(event_type, 'validate') then 'validate'
when regexp_matches(event_type, 'pull|pr') then 'pr' when regexp_matches(event_type, 'write|incident|tag') then 'writeback' else 'impact' end"""
NUMBERED = f"""select cast(user_id as varchar) as run_id, row_number() over (partition by user_id order by ts, event_id) as seq, count(*) over (partition by user_id) as n,
event_id, {PHASE} as phase, cast(0 as bigint) as skipped, user_id from events"""

URN = "'urn:li:dataset:(urn:li:dataPlatform:shop,shop.parts.' || replace(p_brand, '#', '') || ',PROD)'"
CANDIDATES = f"""with n as (select distinct p_partkey % 2 as odd, {URN} as dataset_urn, replace(p_name, ' ', '_') || '_' || lower(p_type) as name from part),
l as (select odd, dataset_urn, name, letter, count(*) as times from (select *, unnest(string_split(name, '')) as letter from n) group by all),
shared as (
  select a.dataset_urn, a.name as old, b.name as new, cast(sum(least(a.times, b.times)) as int) as shared
  from l a join l b on a.odd = 0 and b.odd = 1 and a.dataset_urn = b.dataset_urn and a.letter = b.letter group by all
),
kept as (select * from shared where 40 * shared >= 11 * (length(old) + length(new)))"""

ORACLE_SQL: dict[str, str] = {
    "similar_candidates": f"{CANDIDATES} select * from kept",
    "pruned_candidates": f"""{CANDIDATES}, compared as (select dataset_urn, count(*) as compared from kept group by dataset_urn)
select dataset_urn, pairs, coalesce(compared, 0) as compared
from (select dataset_urn, count(*) filter (odd = 0) * count(*) filter (odd = 1) as pairs from n group by dataset_urn) left join compared using (dataset_urn) where pairs > 0""",
    "nearest_accounts": """with recursive p as (
  select c_nationkey as nation, c_custkey as customer, s_suppkey as supplier, abs(cast(round(c_acctbal * 100) as bigint) - cast(round(s_acctbal * 100) as bigint)) as apart
  from customer join supplier on c_nationkey = s_nationkey
),
r as (select *, row_number() over (partition by nation order by apart, customer, supplier) as k from p where apart <= 50000),
g as (
  select distinct nation, cast(0 as bigint) as k, cast([] as bigint[]) as cs, cast([] as bigint[]) as ss, cast(null as bigint) as customer, cast(null as bigint) as supplier, cast(null as bigint) as apart from r
  union all
  select g.nation, r.k, case when free then list_append(cs, r.customer) else cs end, case when free then list_append(ss, r.supplier) else ss end,
         case when free then r.customer end, case when free then r.supplier end, case when free then r.apart end
  from g join r on r.nation = g.nation and r.k = g.k + 1, lateral (select not list_contains(cs, r.customer) and not list_contains(ss, r.supplier) as free)
)
select nation, customer, supplier, apart from g where customer is not null""",
    "delivered_events": f"select run_id, seq as position, seq, event_id, phase, skipped from ({NUMBERED})",
    "resumed_events": f"""select run_id, seq - had as position, seq, event_id, phase, skipped
from (select *, case when user_id % 2 = 0 then n * 2 // 3 else 0 end as had from ({NUMBERED})) where seq > had""",
    "stored_notes": """select cast(user_id as varchar) as name, max_by(value, event_id) filter (event_type = 'click') as click,
max_by(value, event_id) filter (event_type = 'error') as error, max_by(value, event_id) filter (event_type = 'signup') as signup from events group by user_id""",
    "stored_tags": "select distinct cast(user_id as varchar) as urn, 'type' as field, event_type as tag from events",
    "stored_incidents": """select md5('{"drift":"' || drift || '","dataset":"' || urn || '","column":"error"}') as id, drift, urn as dataset_urn, 'error' as column, case when fixed then 'FIXED' else 'TRIAGE' end as status
from (select 'drop-' || strftime(ts, '%Y-%m-%d') as drift, cast(user_id as varchar) as urn, bool_or(event_type = 'signup') as fixed, bool_or(event_type = 'error') as failed from events group by 1, 2) where failed""",
    "stored_links": """select regexp_extract(url, '://([^/?#]*)', 1) as urn, regexp_extract(url, '^[^?#]*') as url, 'page ' || min(page_id) as label from pages group by 1, 2""",
    "stored_edges": """with chosen as (select s_suppkey from supplier where s_acctbal < 2500)
select distinct cast(l_partkey as varchar) as up_urn, cast(l_suppkey as varchar) as down_urn, case when s_suppkey is null then 'SHIPPED' else 'RETURNED' end as operation
from lineitem left join chosen on l_suppkey = s_suppkey where s_suppkey is null or l_returnflag = 'R'""",
}
