"""What drifted columns do to each asset that has code: a join of lineage hits and code references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import asset_name
from tidemark.operators import lineage, references

LIMIT = 25


def consumed(edges: DataFrame) -> DataFrame:
    """urn, consumed: the columns that a dataset takes in, by dataset, as reports word it."""
    one = edges.groupBy("down_urn", asset_name(F.col("up_urn")).alias("source")).agg(F.sort_array(F.collect_set("up_path")).alias("names"))
    text = F.concat(F.lit("`"), "source", F.lit("` columns {"), F.array_join("names", ", "), F.lit("}"))
    return one.groupBy(F.col("down_urn").alias("urn")).agg(F.array_join(F.sort_array(F.collect_list(text)), "; ").alias("consumed"))


def unmapped_hits(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Column hits without code: each one would be a false negative."""
    return hits.join(assets, "urn", "left_anti")


def universe(code: DataFrame, catalog: DataFrame) -> DataFrame:
    """urn, asset, kind: datasets with code or in the catalog, and jobs with code."""
    assets = code.select(F.col("asset_urn").alias("urn"), "asset", "kind").distinct()
    named = catalog.where(F.col("dataset_urn").contains("dataPlatform:dbt")).select(F.col("dataset_urn").alias("urn")).distinct()
    return named.join(assets, "urn", "full")


def classify(code: DataFrame, edges: DataFrame, table_edges: DataFrame, catalog: DataFrame, begin: DataFrame, max_hops: int = 3, unreached: bool = True) -> DataFrame:
    """drift, urn, asset, kind, bucket, hops, matched_columns, n_references, reason: by drift, for the assets of universe().

    begin: drift, urn and path of each changed column (lineage.starts); all drifts are classified in one plan. A drift
    that adds a column has no path and so nothing to classify: its report is empty. With unreached, every asset has a
    row under every drift, as a report lists them all: that is as many rows as there are pairs. Without, assets that a
    drift's lineage and name don't reach, which are SKIPPED, have none, and all joins are on equal keys; stats() counts
    them from the number of assets.
    """
    begin = begin.where("path is not null")
    changed = begin.select("drift", F.col("urn").alias("changed_urn"), F.col("path").alias("changed"))
    assets = universe(code, catalog)
    hits = lineage.cut(lineage.column_impact(edges, begin, max_hops).withColumnRenamed("hops", "column_hops"))
    if missing := sorted({r["urn"] for r in unmapped_hits(hits, assets.where("asset is not null")).limit(10).collect()}):
        raise LookupError(f"the column's lineage reaches {missing}, which have no code mapped; map it first")
    tables = lineage.cut(lineage.table_downstreams(table_edges, begin, max_hops).withColumnRenamed("hops", "table_hops"))
    refs = references.find(code)
    used = refs.groupBy(F.col("asset_urn").alias("urn")).agg(F.sort_array(F.collect_set("name")).alias("used"))
    matched = references.locations(refs.join(changed, F.lower("name") == F.lower("changed")), "drift", "asset_urn").withColumnRenamed("asset_urn", "urn")
    matched = lineage.cut(matched.drop("lines"))

    if unreached:
        pairs = assets.withColumn("changes", F.lit(1)).join(changed.withColumn("changes", F.lit(1)), "changes")
    else:
        met = [x.select("drift", "urn") for x in (hits, tables, matched)]
        pairs = met[0].union(met[1]).union(met[2]).distinct().join(assets, "urn").join(changed, "drift")
    rows = pairs.join(used, "urn", "left").join(consumed(edges), "urn", "left")
    rows = rows.join(hits, ["drift", "urn"], "left").join(tables, ["drift", "urn"], "left").join(matched, ["drift", "urn"], "left")
    rows = rows.withColumn("n_references", F.coalesce("n_references", F.lit(0)))
    job, on_path, names_it = F.col("kind") == "airflow_task", F.col("column_hops").isNotNull(), F.col("n_references") > 0
    in_graph = F.col("table_hops").isNotNull()
    bucket = F.when(job, F.when(in_graph & names_it, "REQUIRES_PATCH").otherwise("SKIPPED"))
    bucket = bucket.when(on_path & names_it, "REQUIRES_PATCH").when(on_path, "DOWNSTREAM_UNAFFECTED").otherwise("SKIPPED")

    others = F.array_remove("matched_columns", F.col("changed"))
    own = F.array_intersect(others, F.coalesce("used", F.array().cast("array<string>")))
    quoted = lambda *parts: F.concat(F.lit("`"), *parts, F.lit("`"))
    ticked = lambda names: F.array_join(F.transform(names, lambda n: quoted(n)), ", ")
    insulating = F.when(F.size(own) > 0, ticked(own)).when(F.size(others) > 0, ticked(others)).otherwise("only upstream aliases")
    takes = F.coalesce("consumed", F.lit("no cataloged input columns"))
    column, table = quoted(F.col("changed")), quoted(asset_path("changed_urn"))
    full = quoted(asset_path("changed_urn"), F.lit("."), F.col("changed"))
    unmapped = F.lit("This dataset is in the catalog, but no code of it is known, so nothing in it can be searched or patched.")
    # How reports word their reasons.
    reason = (
        F.when(F.col("asset").isNull(), unmapped)
        .when(job & in_graph & names_it, F.concat(F.lit("Table lineage links this task to "), table, F.lit(", and its configured SQL constant references "), column, F.lit(" exactly "), "located", F.lit(".")))
        .when(job, F.concat(F.lit("No exact changed-column reference; configured SQL consumes "), ticked(F.col("used")), F.lit(", not "), column, F.lit(".")))
        .when(on_path & names_it, F.concat(F.lit("SQL references "), column, F.lit(" exactly "), "located", F.lit("; this lineage-bearing file requires repair.")))
        .when(on_path, F.concat(F.lit("Reads "), insulating, F.lit(", aliases created upstream on the changed column's lineage path; "), column, F.lit(" does not appear in this file's SQL. Flagged for review only.")))
        .when(in_graph, F.concat(F.lit("In the table-level downstream graph, but consumes "), takes, F.lit("; none is on the exact "), full, F.lit(" column-lineage path.")))
        .otherwise(F.concat(F.lit("No lineage path from the changed column; this model consumes "), takes, F.lit(", not "), full, F.lit(".")))
    )
    columns = F.when(job & (bucket == "REQUIRES_PATCH"), F.array("changed")).when(on_path, F.col("matched_columns")).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "drift",
        "urn",
        F.coalesce("asset", asset_name(F.col("urn"))).alias("asset"),
        F.coalesce("kind", F.lit("dataset")).alias("kind"),
        bucket.alias("bucket"),
        F.when(job, F.col("table_hops")).otherwise(F.coalesce("column_hops", "table_hops")).alias("hops"),
        columns.alias("matched_columns"),
        "n_references",
        reason.alias("reason"),
    )


def asset_path(urn: str) -> Column:
    return F.regexp_extract(F.col(urn), r"dataPlatform:[^,]+,([^,]+),", 1)


def listed(assets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """By drift, the first assets of its report, by bucket and name; stats() takes them all."""
    order = F.when(F.col("bucket") == "REQUIRES_PATCH", 0).when(F.col("bucket") == "DOWNSTREAM_UNAFFECTED", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("drift").orderBy(order, "asset", "urn"))
    return assets.withColumn("place", place).where(F.col("place") <= limit)


def stats(assets: DataFrame, drifts: DataFrame, total: int | None = None) -> DataFrame:
    """drift and its counts; zeros for a drift (a row of drifts) without assets.

    total: how many assets there are, where assets lacks those that a drift doesn't reach; a drift with a null path has none.
    """
    drifts = drifts if "path" in drifts.columns else drifts.withColumn("path", F.lit(""))
    count = lambda b: F.count_if(F.col("bucket") == b)
    found = drifts.select("drift", "path").distinct().join(assets, "drift", "left").groupBy("drift", "path").agg(
        count("REQUIRES_PATCH").alias("requires_patch"),
        count("DOWNSTREAM_UNAFFECTED").alias("downstream_unaffected"),
        F.count("urn").alias("rows"),
        F.coalesce(F.max(F.coalesce("hops", F.lit(0))), F.lit(0)).alias("max_hops_reached"),
    )
    scanned = F.col("rows") if total is None else F.when(F.col("path").isNotNull(), total).otherwise(0).cast("long")
    found = found.withColumn("total_scanned", scanned)
    return found.select("drift", "requires_patch", "downstream_unaffected", (scanned - F.col("requires_patch") - F.col("downstream_unaffected")).alias("skipped"), "total_scanned", "max_hops_reached")


def graph_nodes(assets: DataFrame, begin: DataFrame, limit: int = LIMIT) -> DataFrame:
    """By drift, the changed column and the report's first assets, as nodes."""
    start = begin.select("drift", "urn", asset_path("urn").alias("name"), F.lit(None).cast("string").alias("bucket"), F.array("path").alias("columns"), F.lit(0).alias("hops"))
    return start.unionByName(listed(assets, limit).select("drift", "urn", F.col("asset").alias("name"), "bucket", F.col("matched_columns").alias("columns"), "hops"))


def visible_edges(edges: DataFrame, nodes: DataFrame, buckets: list[str]) -> DataFrame:
    """Edges whose two ends are shown when only some buckets are; the changed column always is."""
    shown = nodes.where(F.col("bucket").isNull() | F.col("bucket").isin(*buckets)).select("urn")
    return edges.join(shown.withColumnRenamed("urn", "up_urn"), "up_urn", "left_semi").join(shown.withColumnRenamed("urn", "down_urn"), "down_urn", "left_semi")


def captured_queries(usage: DataFrame, column: str, as_of: Column, keep: int = 3, days: int = 365) -> DataFrame:
    """query, used_at: the latest distinct queries of the days before as_of that name a column, the newest first.

    usage: query, used_at. Equal queries are told by a hash, so their texts don't move to be grouped.
    """
    recent = usage.where((F.col("used_at") >= F.timestamp_add("DAY", F.lit(-days), as_of)) & (F.col("used_at") <= as_of))
    naming = recent.where(F.col("query").rlike(rf"(?i)\b\Q{column}\E\b")).withColumn("digest", F.md5("query"))
    latest = naming.groupBy("digest").agg(F.max("used_at").alias("used_at")).orderBy(F.desc("used_at"), "digest").limit(keep)
    chosen = naming.join(F.broadcast(latest), ["digest", "used_at"]).select("digest", "query", "used_at")  # keep rows
    return chosen.groupBy("digest", "used_at").agg(F.min("query").alias("query")).orderBy(F.desc("used_at"), "digest").select("query", "used_at")
