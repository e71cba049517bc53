"""A stored closure kept up to date as edges come and go, by deleting too much and deriving again.

What a lost edge led to, and all downstream of it, is taken out of the closure; of that, what still has an edge
from a place that is reached comes back, with what follows from it; then new edges are followed. Cycles need no
care, as a place that only they keep alive isn't derived again. Joins meet the changed edges and the rows that
they touch; the rest of the closure is read but neither derived nor followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

KEY = ["drift", "urn", "path"]


def ends(edges: DataFrame) -> DataFrame:
    """Edges by what they join, names without their case."""
    return edges.select(*(F.lower(c).alias(c) for c in ("up_urn", "up_path", "down_urn", "down_path"))).distinct()


def ahead(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """What edges lead to from a frontier of drift, urn and path."""
    met = frontier.join(edges, (F.col("urn") == F.col("up_urn")) & (F.col("path") == F.col("up_path")))
    return met.select("drift", F.col("down_urn").alias("urn"), F.col("down_path").alias("path")).distinct()


def followed(frontier: DataFrame, edges: DataFrame, among: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    """The frontier and all that edges lead to from it: only among some rows, and but for others, if those are given."""
    found = frontier = cut(frontier)
    while not frontier.isEmpty():
        rows = ahead(frontier, edges)
        rows = rows if among is None else rows.join(among, KEY, "left_semi")
        rows = rows if but is None else rows.join(but, KEY, "left_anti")
        frontier = cut(rows.join(found, KEY, "left_anti"))
        found = cut(found.union(frontier))
    return found


def maintained(reached: DataFrame, begin: DataFrame, edges: DataFrame, lost: DataFrame, gained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure after edges were lost and gained, and the rows that were touched: drift, urn, path and what became of them (gone, again or new).

    reached: the closure of edges (drift, urn, path) from begin; lost: some of edges; gained: others. Names are in lower case.
    """
    low = lambda rows: rows.select("drift", *(F.lower(c).alias(c) for c in ("urn", "path"))).distinct()
    begin, known = low(begin), cut(low(reached))
    old, lost, gained = ends(edges), cut(ends(lost)), cut(ends(gained))
    new = cut(old.join(lost, old.columns, "left_anti").union(gained).distinct())
    sources = known.union(begin).distinct()
    doubtful = followed(ahead(sources, lost).join(known, KEY, "left_semi"), old, among=known)
    sure = cut(known.join(doubtful, KEY, "left_anti"))
    # Only edges into doubtful rows can bring them back.
    into = new.join(doubtful.select(F.col("urn").alias("down_urn"), F.col("path").alias("down_path")).distinct(), ["down_urn", "down_path"], "left_semi").select(*new.columns)
    back = followed(ahead(sure.union(begin).distinct(), cut(into)).join(doubtful, KEY, "left_semi"), new, among=doubtful)
    kept = cut(sure.union(back))
    more = followed(ahead(kept.union(begin).distinct(), gained).join(kept, KEY, "left_anti"), new, but=kept).join(begin, KEY, "left_anti")
    status = lambda rows, s: rows.withColumn("became", F.lit(s))
    gone = doubtful.join(back, KEY, "left_anti").join(more, KEY, "left_anti")
    touched = status(gone, "gone").union(status(back, "again")).union(status(more, "new"))
    return cut(kept.union(more)), touched
