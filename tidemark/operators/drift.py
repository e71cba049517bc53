"""Schema drift between two snapshots of catalog columns, as joins.

A snapshot has dataset_urn, ordinal, name, native_type (other columns are ignored). Datasets that only one
snapshot has take no part. Names compare with their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import dataset_name, drift_id
from tidemark.operators import matching
from tidemark.operators.lineage import cut

LEAST = (11, 20)
THRESHOLD = LEAST[0] / LEAST[1]
EVENT = ("id", "kind", "dataset_urn", "dataset_name", "old_column", "new_column", "old_type", "new_type", "confidence", "rationale")


def _side(snapshot: DataFrame, prefix: str) -> DataFrame:
    return snapshot.select("dataset_urn", F.col("name").alias(f"{prefix}_column"), F.col("native_type").alias(f"{prefix}_type"), F.col("ordinal").alias(f"{prefix}_ordinal"))


def retyped(baseline: DataFrame, live: DataFrame) -> DataFrame:
    old, new = _side(baseline, "old"), _side(live, "new")
    same = old.join(new, (old.dataset_urn == new.dataset_urn) & (old.old_column == new.new_column)).drop(new.dataset_urn)
    return same.where("old_type <> new_type")


def removed(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Columns of the baseline that a dataset no longer has, though it is still there."""
    old = _side(baseline, "old").join(live.select("dataset_urn").distinct(), "dataset_urn", "left_semi")
    gone = _side(live, "new").select("dataset_urn", F.col("new_column").alias("old_column"))
    return old.join(gone, ["dataset_urn", "old_column"], "left_anti").select("dataset_urn", "old_column", "old_type", "old_ordinal")


def added(baseline: DataFrame, live: DataFrame) -> DataFrame:
    return removed(live, baseline).toDF("dataset_urn", "new_column", "new_type", "new_ordinal")


Sides = tuple[DataFrame, DataFrame]


def sides(baseline: DataFrame, live: DataFrame) -> Sides:
    """Removed columns and added ones, each with how many of either its dataset has; datasets that lack one kind have none to pair."""
    old, new = removed(baseline, live), added(baseline, live)
    n_old = old.groupBy("dataset_urn").agg(F.count_distinct("old_column").cast("int").alias("n_removed"))
    n_new = new.groupBy("dataset_urn").agg(F.count_distinct("new_column").cast("int").alias("n_added"))
    counts = cut(n_old.join(n_new, "dataset_urn"))
    return old.join(counts, "dataset_urn"), new.join(counts.select("dataset_urn"), "dataset_urn")


def compared(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("same_type", F.col("old_type") == F.col("new_type")).withColumn("same_ordinal", F.col("old_ordinal") == F.col("new_ordinal"))


def candidates(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Every removed column of a dataset beside every added one, with what ranks them."""
    old, new = sides(baseline, live)
    return compared(old.join(new, "dataset_urn"))


def renamed_fast(baseline: DataFrame, live: DataFrame, known: Sides | None = None) -> DataFrame:
    """One column gone, one come, of the same type: a rename whatever the names."""
    old, new = known or sides(baseline, live)
    pairs = compared(old.where("n_removed = 1 and n_added = 1").join(new, "dataset_urn"))
    return pairs.where("same_type").withColumn("confidence", F.lit(0.95)).withColumn("similarity", F.lit(None).cast("double"))


def renamed_greedy(baseline: DataFrame, live: DataFrame, known: Sides | None = None) -> DataFrame:
    """Otherwise the best pair first, then the best of what is left, down to the threshold.

    Only names whose letters allow the threshold are compared, and pairs are taken in rounds over all datasets
    (operators.matching).
    """
    old, new = known or sides(baseline, live)
    old = cut(old.where("not (n_removed = 1 and n_added = 1)"))
    named = matching.alike(old.select("dataset_urn", F.col("old_column").alias("name")), new.join(old.select("dataset_urn").distinct(), "dataset_urn", "left_semi").select("dataset_urn", F.col("new_column").alias("name")), ["dataset_urn"], LEAST)
    named = named.withColumnsRenamed({"old": "old_column", "new": "new_column"})
    many = compared(named.join(old, ["dataset_urn", "old_column"]).join(new, ["dataset_urn", "new_column"]))
    ends = ["dataset_urn", "old_column"], ["dataset_urn", "new_column"]
    taken = matching.greedy(many, *ends, ["same_type", "similarity", "same_ordinal", "old_column", "new_column"])
    score = F.when(F.col("same_type"), 0.5).otherwise(0.0) + 0.4 * F.col("similarity") + F.when(F.col("same_ordinal"), 0.1).otherwise(0.0)
    return taken.withColumn("confidence", F.least(F.lit(0.9), score))


def renamed(baseline: DataFrame, live: DataFrame) -> DataFrame:
    known = sides(baseline, live)
    return renamed_fast(baseline, live, known).unionByName(renamed_greedy(baseline, live, known))


def dropped(baseline: DataFrame, live: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Removed columns that no rename takes; pairs: the renames, where they are known already."""
    pairs = renamed(baseline, live) if pairs is None else pairs
    return removed(baseline, live).join(pairs.select("dataset_urn", "old_column"), ["dataset_urn", "old_column"], "left_anti")


def appeared(baseline: DataFrame, live: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    pairs = renamed(baseline, live) if pairs is None else pairs
    return added(baseline, live).join(pairs.select("dataset_urn", "new_column"), ["dataset_urn", "new_column"], "left_anti")


def event(rows: DataFrame, kind: str, confidence: Column, rationale: Column) -> DataFrame:
    """rows, which lack some of the four columns and types of an event, as events."""
    for c in ("old_column", "new_column", "old_type", "new_type"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("kind", F.lit(kind)).withColumn("confidence", confidence.cast("double")).withColumn("rationale", rationale)
    rows = rows.withColumn("dataset_name", dataset_name(F.col("dataset_urn")))
    return rows.withColumn("id", drift_id(F.col("kind"), F.col("dataset_urn"), F.col("old_column"), F.col("new_column"))).select(*EVENT)


def _rename_rationale() -> Column:
    # How rationales are worded.
    place = F.when(F.col("same_ordinal"), F.format_string("the same ordinal position (%d)", "old_ordinal"))
    fast = F.when(F.col("same_ordinal"), F.format_string("the same type %s at the same ordinal position (%d)", "old_type", "old_ordinal"))
    fast = fast.otherwise(F.format_string("the same type %s; its ordinal position moved from %d to %d", "old_type", "old_ordinal", "new_ordinal"))
    kinds = F.when(F.col("same_type"), F.concat(F.lit("the same native type "), "old_type")).otherwise("different native types")
    slow = F.concat(kinds, F.format_string(", name similarity %.2f, and ", "similarity"), F.coalesce(place, F.format_string("ordinal positions %d and %d", "old_ordinal", "new_ordinal")))
    evidence = F.when(F.col("similarity").isNull(), fast).otherwise(slow)
    return F.format_string("`%s` disappeared and `%s` appeared with %s — inferred as a rename with %.2f confidence.", F.col("old_column"), F.col("new_column"), evidence, F.col("confidence"))


def detect(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """All drift events. Sort by dataset_name and id to list them."""
    # How rationales are worded.
    typed = F.format_string("`%s` remains present, but its native type changed from %s to %s — detected as a retype.", "old_column", "old_type", "new_type")
    gone = F.format_string(f"`%s` disappeared from the live schema and no added column met the {THRESHOLD:.2f} rename-similarity threshold — detected as a drop.", "old_column")
    come = F.format_string("`%s` appeared in the live schema without a credible removed-column match — detected as an add.", "new_column")
    pairs = cut(renamed(baseline, live))
    found = event(retyped(baseline, live), "RETYPE", F.lit(1.0), typed)
    found = found.unionByName(event(pairs, "RENAME", F.col("confidence"), _rename_rationale()))
    found = found.unionByName(event(dropped(baseline, live, pairs), "DROP", F.lit(1.0), gone))
    return found.unionByName(event(appeared(baseline, live, pairs), "ADD", F.lit(1.0), come))


def declare(rows: DataFrame) -> DataFrame:
    """Events from declared facts: kind, dataset_urn, old_column, new_column, old_type, new_type."""
    subject = F.coalesce("old_column", "new_column", F.lit("schema"))
    # How rationales are worded.
    text = (
        F.when(F.col("kind") == "RENAME", F.format_string("An explicit declaration states that `%s` was renamed to `%s`.", "old_column", "new_column"))
        .when(F.col("kind") == "RETYPE", F.format_string("An explicit declaration states that `%s` changed type from %s to %s.", subject, F.col("old_type"), F.col("new_type")))
        .when(F.col("kind") == "DROP", F.format_string("An explicit declaration states that upstream column `%s` was dropped.", "old_column"))
        .otherwise(F.format_string("An explicit declaration states that upstream column `%s` was added.", "new_column"))
    )
    rows = rows.withColumn("confidence", F.lit(1.0)).withColumn("rationale", text).withColumn("dataset_name", dataset_name(F.col("dataset_urn")))
    return rows.withColumn("id", drift_id(F.col("kind"), F.col("dataset_urn"), F.col("old_column"), F.col("new_column"))).select(*EVENT)


def select_event(events: DataFrame, drift: str) -> DataFrame:
    """The active event of an id; another id is an error that names those there are."""
    if not (found := events.where(F.col("id") == drift)).limit(1).count():
        known = ", ".join(r["id"] for r in events.select("id").distinct().orderBy("id").limit(50).collect())
        raise LookupError(f"no active drift {drift!r}; active: {known or 'none'}")
    return found


def simulate(columns: DataFrame, kind: str, urn: str, column: str, to: str | None = None) -> DataFrame:
    """A snapshot after one change; the given one stays as it is. to: the new name or the new native type."""
    here = (F.col("dataset_urn") == urn) & (F.col("name") == column)
    if kind == "RENAME":
        return columns.withColumn("name", F.when(here, F.lit(to)).otherwise(F.col("name")))
    if kind == "RETYPE":
        return columns.withColumn("native_type", F.when(here, F.lit(to)).otherwise(F.col("native_type")))
    if kind == "DROP":
        # A column after the one that goes moves up by one.
        at = columns.where(here).select("dataset_urn", F.col("ordinal").alias("_gone"))
        rest = columns.where(~here).join(F.broadcast(at), "dataset_urn", "left")
        return rest.withColumn("ordinal", F.col("ordinal") - (F.col("ordinal") > F.coalesce("_gone", F.lit(1 << 30))).cast("int")).select(*columns.columns)
    raise ValueError(f"no simulation of {kind}")
