"""Records that a repair leaves behind, as upserts on tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import incident_id


def summary(actions: DataFrame) -> DataFrame:
    """kind, target, ok, failed, error: actions by target; errors are joined in order."""
    failed = ~F.col("ok")
    said = F.transform(F.sort_array(F.collect_list(F.when(failed, F.struct("seq", F.coalesce("error", "detail").alias("e"))))), lambda x: x["e"])
    out = actions.groupBy("kind", "target").agg(F.bool_and("ok").alias("ok"), F.count_if(failed).alias("failed"), F.array_join(said, "; ").alias("error"))
    return out.withColumn("error", F.when(F.col("error") != "", F.col("error")))


def reconcile(edges: DataFrame, corrected: DataFrame, urns: DataFrame) -> DataFrame:
    """edges with those into the datasets of urns replaced by corrected ones."""
    into = urns.select(F.col("urn").alias("down_urn")).distinct()
    return edges.join(into, "down_urn", "left_anti").unionByName(corrected.join(into, "down_urn", "left_semi")).distinct()


def document(columns: DataFrame, notes: DataFrame) -> DataFrame:
    """columns with the descriptions of notes (dataset_urn, name, description); other fields stay."""
    new = notes.groupBy("dataset_urn", "name").agg(F.max("description").alias("_new"))
    return columns.join(new, ["dataset_urn", "name"], "left").withColumn("description", F.coalesce("_new", "description")).select(*columns.columns)


def tag(tags: DataFrame, added: DataFrame) -> DataFrame:
    """Tags with more of them, each once: urn, field, tag."""
    return tags.unionByName(added).distinct()


def incidents(drifts: DataFrame, review: DataFrame) -> DataFrame:
    """id, drift, dataset_urn, column, status: FIXED once a review (drift, reference) is a web address, else TRIAGE."""
    web = review.where(F.col("reference").rlike("^https?://[^/]+")).select("drift").distinct().withColumn("fixed", F.lit(True))
    rows = drifts.join(web, drifts["id"] == web["drift"], "left").select(drifts["id"].alias("drift"), "dataset_urn", F.coalesce("old_column", "new_column").alias("column"), "fixed")
    return rows.select(incident_id(F.col("drift"), F.col("dataset_urn"), F.col("column")).alias("id"), "drift", "dataset_urn", "column", F.when(F.col("fixed"), "FIXED").otherwise("TRIAGE").alias("status"))


def links(known: DataFrame, added: DataFrame) -> DataFrame:
    """Links by dataset and address, each address once; the label that was there stays."""
    both = known.withColumn("_o", F.lit(0)).unionByName(added.withColumn("_o", F.lit(1)))
    return both.groupBy("urn", "url").agg(F.min_by("label", "_o").alias("label"))


def guarded_delete(datasets: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Datasets that stay, and an audit row for each that goes: only names under the prefix may."""
    if not prefix or not prefix.endswith("."):
        raise ValueError("a namespace prefix ends in a dot; an empty one would delete everything")
    mine = F.col("name").startswith(prefix)
    return datasets.where(~mine), datasets.where(mine).select("name", F.lit("deleted").alias("action"))


def list_namespace(datasets: DataFrame, prefix: str) -> DataFrame:
    return datasets.where(F.col("name").startswith(prefix)).select("name").distinct()
