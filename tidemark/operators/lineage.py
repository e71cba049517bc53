"""Lineage reachability by frontier joins over edge tables.

A hop joins the nodes found last with the edges and leaves out those found before. Only the frontier grows
a step; whole paths are never enumerated, so diamonds and cycles cost what their edges cost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str | None:
    """A new path in the folder that driver and executors share; None in a local session that names none."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return None


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a written table; in a local session without a folder for that, cached."""
    spark = df.sparkSession
    if not (path := shared_path(spark, "frontier")):
        return df.cache()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def starts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Where searches begin: drift, urn, path; one row for each drift. Any table of these columns will do."""
    return spark.createDataFrame(rows, "drift string, urn string, path string").coalesce(1)


def column_hops(edges: DataFrame, begin: DataFrame, max_hops: int = 3, staged: bool = False) -> DataFrame:
    """drift, urn, path, hops, via: the columns downstream of each start within max_hops, and one shortest path to each.

    All drifts advance in the same joins. via lists the steps of the path that sorts first among the shortest. staged:
    what a hop finds is written, not found again for those behind it.
    """
    step = F.struct("up_urn", "up_path", "down_urn", "down_path", "operation")
    none = F.array().cast("array<struct<up_urn:string,up_path:string,down_urn:string,down_path:string,operation:string>>")
    found = begin.select("drift", "urn", "path", F.lit(0).alias("hops"), none.alias("via"))
    frontier = found
    for hop in range(1, max_hops + 1):
        ahead = frontier.join(edges, (F.col("urn") == F.col("up_urn")) & (F.col("path") == F.col("up_path")))
        ahead = ahead.select("drift", F.col("down_urn").alias("urn"), F.col("down_path").alias("path"), F.concat("via", F.array(step)).alias("via"))
        ahead = ahead.repartition("drift", "urn", "path") if staged else ahead  # else paths are sorted where edges are read, by as few tasks
        ahead = ahead.groupBy("drift", "urn", "path").agg(F.min("via").alias("via")).withColumn("hops", F.lit(hop))
        frontier = ahead.join(found.select("drift", "urn", "path"), ["drift", "urn", "path"], "left_anti")
        frontier = cut(frontier) if staged else frontier
        found = found.unionByName(frontier)
    return found.where("hops > 0")


def reached(edges: DataFrame, begin: DataFrame, max_hops: int = 3) -> DataFrame:
    """drift, urn: the datasets downstream of each start within max_hops, without the paths to them; what a hop finds is written."""
    found = frontier = begin.select("drift", "urn", "path")
    for _ in range(max_hops):
        ahead = frontier.join(edges, (F.col("urn") == F.col("up_urn")) & (F.col("path") == F.col("up_path")))
        ahead = ahead.select("drift", F.col("down_urn").alias("urn"), F.col("down_path").alias("path")).distinct()
        frontier = cut(ahead.join(found, ["drift", "urn", "path"], "left_anti"))
        found = found.unionByName(frontier)
    return beyond(found, begin).select("drift", "urn").distinct()


def beyond(hops: DataFrame, begin: DataFrame) -> DataFrame:
    """Hops without those back to the start's own dataset."""
    return hops.join(begin.select("drift", "urn"), ["drift", "urn"], "left_anti")


def column_impact(edges: DataFrame, begin: DataFrame, max_hops: int = 3, staged: bool = False) -> DataFrame:
    """drift, urn, hops, matched_columns: the datasets downstream of each start, and all columns on the paths to each."""
    hops = beyond(column_hops(edges, begin, max_hops, staged), begin)
    named = hops.select("drift", "urn", "hops", F.explode(F.concat(F.array("path"), F.transform("via", lambda v: v["up_path"]))).alias("name"))
    return named.groupBy("drift", "urn").agg(F.min("hops").alias("hops"), F.sort_array(F.collect_set("name")).alias("matched_columns"))


def table_downstreams(table_edges: DataFrame, begin: DataFrame, max_hops: int = 3) -> DataFrame:
    """drift, urn, hops: datasets and jobs downstream of each start's table, through both."""
    found = begin.select("drift", "urn", F.lit(0).alias("hops"))
    frontier = found
    for hop in range(1, max_hops + 1):
        ahead = frontier.join(table_edges, F.col("urn") == F.col("up_urn")).select("drift", F.col("down_urn").alias("urn")).distinct()
        frontier = ahead.join(found, ["drift", "urn"], "left_anti").withColumn("hops", F.lit(hop))
        found = found.unionByName(frontier)
    return found.where("hops > 0")


def closure(edges: DataFrame, begin: DataFrame) -> DataFrame:
    """drift, urn, path: everything downstream of each start, names without their case, however far."""
    low = lambda c: F.lower(F.col(c)).alias(c)
    edges = edges.select(low("up_urn"), low("up_path"), low("down_urn"), low("down_path"), F.col("down_urn").alias("as_is"), F.col("down_path").alias("path_as_is"))
    start = begin.select("drift", F.lower("urn").alias("k"), F.lower("path").alias("p"), "urn", "path")
    found = frontier = start
    while True:
        ahead = frontier.select("drift", "k", "p").join(edges, (F.col("k") == F.col("up_urn")) & (F.col("p") == F.col("up_path")))
        ahead = ahead.groupBy("drift", F.col("down_urn").alias("k"), F.col("down_path").alias("p")).agg(F.min("as_is").alias("urn"), F.min("path_as_is").alias("path"))
        frontier = cut(ahead.join(found, ["drift", "k", "p"], "left_anti"))
        if frontier.isEmpty():
            return found.join(start, ["drift", "k", "p"], "left_anti").select("drift", "urn", "path")
        found = cut(found.unionByName(frontier))


def shortest_paths(edges: DataFrame, begin: DataFrame, max_hops: int = 3, staged: bool = False) -> DataFrame:
    """drift, urn, hops, via: one shortest path to each dataset; of equals the one whose steps sort first."""
    hops = beyond(column_hops(edges, begin, max_hops, staged), begin)
    return hops.groupBy("drift", "urn").agg(F.min(F.struct("hops", "via")).alias("best")).select("drift", "urn", "best.hops", "best.via")


def graph_edges(edges: DataFrame, begin: DataFrame, max_hops: int = 3) -> DataFrame:
    """drift and every edge out of its start or a column downstream of it, once."""
    seen = begin.select("drift", "urn", "path").unionByName(column_hops(edges, begin, max_hops - 1).select("drift", "urn", "path"))
    out = edges.join(seen, (F.col("up_urn") == F.col("urn")) & (F.col("up_path") == F.col("path"))).select("drift", *edges.columns)
    # Of edges alike in all but their operation the last name stands.
    return out.groupBy("drift", "up_urn", "up_path", "down_urn", "down_path").agg(F.max("operation").alias("operation"))


def has_outgoing(edges: DataFrame, urn: str) -> DataFrame:
    return edges.agg(F.coalesce(F.bool_or(F.col("up_urn") == urn), F.lit(False)).alias("has_edge"))


def disagreement(edges: DataFrame, searched: DataFrame, begin: DataFrame) -> DataFrame:
    """drift, urn: datasets that the closure reaches and a search (of columns drift and urn) does not."""
    expected = beyond(closure(edges, begin), begin).select("drift", "urn").distinct()
    return expected.join(searched.select("drift", "urn").distinct(), ["drift", "urn"], "left_anti")


def agreement(edges: DataFrame, searched: DataFrame, begin: DataFrame) -> DataFrame:
    """drift, verdict: agreed, narrowed (nothing is downstream of this column, though others have edges), refused or missing."""
    missing = disagreement(edges, searched, begin).groupBy("drift").agg(F.lit(True).alias("missing"))
    hit = searched.select("drift").distinct().withColumn("hit", F.lit(True))
    out = edges.select(F.col("up_urn").alias("urn")).distinct().withColumn("out", F.lit(True))
    rows = begin.join(missing, "drift", "left").join(hit, "drift", "left").join(out, "urn", "left")
    verdict = F.when(F.col("missing"), "missing").when(F.col("hit"), "agreed").when(F.col("out"), "narrowed").otherwise("refused")
    return rows.select("drift", verdict.alias("verdict"))


def flattened(nested: DataFrame) -> DataFrame:
    """Column edges from nested lineage, a row for each pair: dataset_urn and lineage, an array of upstreams and downstreams
    (arrays of urn and path; a downstream without urn is the dataset's own) with the operation between them.

    A null or empty side makes no edge; pairs that repeat are one edge for each operation.
    """
    one = nested.select("dataset_urn", F.explode("lineage").alias("l")).select("dataset_urn", "l.operation", "l.downstreams", F.explode("l.upstreams").alias("up"))
    pair = one.select("dataset_urn", "operation", "up", F.explode("downstreams").alias("down"))
    down = F.coalesce("down.urn", "dataset_urn")
    return pair.select(F.col("up.urn").alias("up_urn"), F.col("up.path").alias("up_path"), down.alias("down_urn"), F.col("down.path").alias("down_path"), "operation").distinct()


def corrected(edges: DataFrame, kind: str, old: str, new: str | None = None) -> DataFrame:
    """Edges as they stand after a repair: renamed at either end, or without those that touch a dropped column."""
    if kind == "DROP":
        return edges.where(~((F.col("up_path") == old) | (F.col("down_path") == old)))
    if kind != "RENAME":
        return edges
    name: Column = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return edges.select(*(name(c) if c in ("up_path", "down_path") else c for c in edges.columns))


def documentation_targets(edges: DataFrame, changed: str) -> DataFrame:
    """urn, column: where a change is noted in each dataset: the changed name if it comes out, else the first output."""
    out = edges.where(F.col("up_path") == changed).groupBy(F.col("down_urn").alias("urn"))
    return out.agg(F.coalesce(F.max(F.when(F.col("down_path") == changed, F.col("down_path"))), F.min("down_path")).alias("column"))


def dangling(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Edges whose upstream column no dataset declares."""
    known = columns.select(F.col("dataset_urn").alias("up_urn"), F.col("name").alias("up_path"))
    return edges.join(known, ["up_urn", "up_path"], "left_anti")
