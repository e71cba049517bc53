"""The registered queries over the workload and its metadata, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import asset_name, dataset_name
from tidemark.operators import analysis, docs, dq, drift, impact, lineage, references, repair, snapshot, validate, writeback
from tidemark.plans import fixtures as fx
from tidemark.plans import graphs, markup, tables
from tidemark.plans.models import EXTRACTS, MODELS, build
from tidemark.plans.oracles import ORACLES
from tidemark.sources.warehouse import parquet
from tidemark.streaming import events

Query = Callable[[SparkSession, str], DataFrame]

#: The drifts that the queries look at: kind, dataset, column, new name or type.
SCENARIOS = {
    "rename": ("RENAME", "orders", "order_placed_at", "order_created_at"),
    "retype": ("RETYPE", "orders", "gross_amount", "VARCHAR(20)"),
    "drop": ("DROP", "customers", "marketing_opt_in", None),
}


def model_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = build(spark, sf_dir, name)
        for c, kind in rows.dtypes:  # one type for money in all engines
            if kind.startswith("decimal"):
                rows = rows.withColumn(c, F.col(c).cast("double"))
        return rows

    run.__name__ = name
    return run


def live_catalog(spark: SparkSession, scenario: str) -> DataFrame:
    kind, dataset, column, to = SCENARIOS[scenario]
    return drift.simulate(fx.catalog_columns(spark), kind, fx.urn(dataset), column, to)


def all_changes(spark: SparkSession) -> DataFrame:
    live = fx.catalog_columns(spark)
    for kind, dataset, column, to in SCENARIOS.values():
        live = drift.simulate(live, kind, fx.urn(dataset), column, to)
    return live


def mixed_snapshots(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    schema = "dataset_urn string, ordinal int, name string, native_type string"
    return fx.local(spark, fx.MIXED_BASELINE, schema), fx.local(spark, fx.MIXED_LIVE, schema)


def scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "orders")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.catalog_columns(spark)


def list_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fx.catalog_columns(spark).select(dataset_name(F.col("dataset_urn")).alias("name"))
    return writeback.list_namespace(named, "shop_prod.analytics.")


def captured_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts stand in for captured queries, each used on a day told by its id: the last of a year that say a word."""
    docs = parquet(spark, sf_dir, "documents")
    day = F.timestamp_add("DAY", -(F.col("doc_id") % 730).cast("int"), F.lit("2025-01-01").cast("timestamp_ntz"))
    usage = docs.select(F.col("text").alias("query"), day.alias("used_at"))
    found = impact.captured_queries(usage, "the", F.lit("2025-01-01").cast("timestamp_ntz"))
    return found.select("used_at", F.length("query").cast("long").alias("chars"), F.md5("query").alias("digest"))


def drift_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drift.retyped(fx.catalog_columns(spark), all_changes(spark))
    return rows.select("dataset_urn", F.col("old_column").alias("name"), "old_type", "new_type")


def drift_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.removed(fx.catalog_columns(spark), all_changes(spark)).select("dataset_urn", F.col("old_column").alias("name"))


def drift_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.added(fx.catalog_columns(spark), all_changes(spark)).select("dataset_urn", F.col("new_column").alias("name"))


def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, live = mixed_snapshots(spark)
    return drift.candidates(baseline, live).select("dataset_urn", "old_column", "new_column", "same_type", "same_ordinal", F.col("n_removed").cast("long").alias("n_removed"), F.col("n_added").cast("long").alias("n_added"))


def drift_rename_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.renamed_fast(fx.catalog_columns(spark), all_changes(spark)).select("dataset_urn", "old_column", "new_column", "confidence")


def drift_rename_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, live = mixed_snapshots(spark)
    return drift.renamed_greedy(baseline, live).select("dataset_urn", "old_column", "new_column", "confidence")


def drift_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.dropped(fx.catalog_columns(spark), all_changes(spark)).select("dataset_urn", "old_column")


def drift_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, live = mixed_snapshots(spark)
    return drift.appeared(baseline, live).select("dataset_urn", "new_column")


def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.detect(fx.catalog_columns(spark), all_changes(spark)).drop("rationale")


def schema_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots' columns side by side."""
    old, new = fx.catalog_columns(spark), all_changes(spark)
    pick = lambda df, p: df.select("dataset_urn", "name", F.col("native_type").alias(f"{p}_type"))
    return pick(old, "old").join(pick(new, "new"), ["dataset_urn", "name"], "full")


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.column_edges(spark)


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table_edges(spark).distinct()


def starts(spark: SparkSession, *scenarios: str) -> DataFrame:
    """Where the named scenarios' searches begin; all scenarios if none is named."""
    return fx.local(spark, [(s, fx.urn(SCENARIOS[s][1]), SCENARIOS[s][2]) for s in scenarios or SCENARIOS], "drift string, urn string, path string")


def column_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.column_impact(fx.column_edges(spark), starts(spark))
    return found.select("drift", "urn", "hops", F.array_join("matched_columns", ",").alias("matched_columns"))


def table_downstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.table_downstreams(fx.table_edges(spark), starts(spark))


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.closure(fx.column_edges(spark), starts(spark))


def lineage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.shortest_paths(fx.column_edges(spark), starts(spark))
    step = lambda v: F.concat(asset_name(v["up_urn"]), F.lit("."), v["up_path"], F.lit(">"), asset_name(v["down_urn"]), F.lit("."), v["down_path"])
    return found.select("drift", "urn", "hops", F.array_join(F.transform("via", step), " ").alias("steps"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.graph_edges(fx.column_edges(spark), starts(spark))


def has_outgoing_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.has_outgoing(fx.column_edges(spark), fx.urn("mart_customer_ltv"))


def lineage_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of one hop misses of the closure."""
    edges, begin = fx.column_edges(spark), starts(spark)
    return lineage.disagreement(edges, lineage.column_impact(edges, begin, max_hops=1), begin)


def lineage_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control column reaches a strict subset of what the drifted one reaches."""
    begin = fx.local(spark, [(c, fx.urn("orders"), c) for c in ("order_placed_at", "order_status")], "drift string, urn string, path string")
    return lineage.closure(fx.column_edges(spark), begin).select("urn", F.col("drift").alias("reached_by")).distinct()


def nested_lineage(spark: SparkSession) -> DataFrame:
    """The column edges as catalogs hold them: by dataset, an array of entries with arrays of upstreams and downstreams."""
    edge = F.struct("operation", F.array(F.struct(F.col("up_urn").alias("urn"), F.col("up_path").alias("path"))).alias("upstreams"), F.array(F.struct(F.lit(None).cast("string").alias("urn"), F.col("down_path").alias("path"))).alias("downstreams"))
    return fx.column_edges(spark).groupBy(F.col("down_urn").alias("dataset_urn")).agg(F.collect_list(edge).alias("lineage"))


def flattened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.flattened(nested_lineage(spark))


def corrected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, _, old, new = SCENARIOS["rename"]
    return lineage.corrected(fx.column_edges(spark), kind, old, new)


def documentation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.documentation_targets(fx.column_edges(spark), "order_placed_at")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a rename at the source, the declared edges that no longer start at a column."""
    return lineage.dangling(fx.column_edges(spark), live_catalog(spark, "rename"))


def assets(spark: SparkSession, *scenarios: str, unreached: bool = True) -> DataFrame:
    return impact.classify(fx.code_lines(spark), fx.column_edges(spark), fx.table_edges(spark), fx.catalog_columns(spark), starts(spark, *scenarios), unreached=unreached)


def impact_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hops is 0 for what no drift reaches."""
    return assets(spark).select(F.col("drift").alias("scenario"), "asset", "bucket", F.coalesce("hops", F.lit(0)).alias("hops"))


def impact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a drift that adds a column, whose report is empty."""
    added = fx.local(spark, [("add", fx.urn("orders"), None)], "drift string, urn string, path string")
    total = impact.universe(fx.code_lines(spark), fx.catalog_columns(spark)).count()
    return impact.stats(assets(spark, unreached=False), starts(spark).unionByName(added), total).withColumnRenamed("drift", "scenario")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = impact.graph_nodes(assets(spark), starts(spark))
    return nodes.select(F.col("drift").alias("scenario"), "urn", "name", "bucket", "hops", F.array_join("columns", ",").alias("columns"))


def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a scenario's graph when only what needs a patch is shown."""
    nodes = impact.graph_nodes(assets(spark, "rename"), starts(spark, "rename"))
    return impact.visible_edges(lineage.graph_edges(fx.column_edges(spark), starts(spark, "rename")).drop("drift"), nodes, ["REQUIRES_PATCH"])


def consumed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.consumed(fx.column_edges(spark))


def reference_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references.matching(references.find(fx.code_lines(spark)), "order_placed_at")
    return references.locations(refs).select("asset_urn", "n_references", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def repaired(spark: SparkSession, scenario: str) -> tuple[DataFrame, DataFrame]:
    """The code after a scenario's repair, and what it patched."""
    kind, dataset, column, to = SCENARIOS[scenario]
    code = fx.code_lines(spark)
    patch = lineage.cut(assets(spark, scenario).where("bucket = 'REQUIRES_PATCH'").select(F.col("urn").alias("asset_urn")))
    if kind == "RENAME":
        return lineage.cut(repair.rename(code, patch, column, to)), patch
    if kind == "RETYPE":
        return lineage.cut(repair.retype(code, patch, column, {n: kind for n, kind, _ in fx.definitions()[dataset]}[column])), patch
    return lineage.cut(repair.drop(code, patch, column, "2025-01-01")), patch


def input_names(spark: SparkSession) -> DataFrame:
    return fx.local(spark, [(n, fx.urn(n)) for n in fx.definitions()], "input string, dataset_urn string")


def checked(spark: SparkSession, scenario: str) -> DataFrame:
    kind, dataset, column, _ = SCENARIOS[scenario]
    code, patch = repaired(spark, scenario)
    return validate.checks(code, live_catalog(spark, scenario), patch, input_names(spark), kind, fx.urn(dataset), column)


def reference_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, "rename")


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for s in SCENARIOS:
        one = validate.summary(checked(spark, s)).withColumn("scenario", F.lit(s))
        found = one if found is None else found.unionByName(one)
    return found


def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.gate(checked(spark, "rename"))


def repair_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for s in SCENARIOS:
        one = repair.patches(fx.code_lines(spark), repaired(spark, s)[0]).withColumn("scenario", F.lit(s))
        found = one if found is None else found.unionByName(one)
    return found


def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of every declared not-null test, each dataset scanned once."""
    found = None
    for d in fx.definitions():
        columns = [c for t, c, test in fx.test_rows() if t == d and test == "not_null"]
        one = dq.not_null(build(spark, sf_dir, d), columns).withColumn("dataset", F.lit(d))
        found = one if found is None else found.unionByName(one)
    return found


def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of every declared unique test."""
    found = None
    for d, c, test in fx.test_rows():
        if test == "unique":
            one = dq.unique(build(spark, sf_dir, d), c).withColumn("dataset", F.lit(d))
            found = one if found is None else found.unionByName(one)
    return found


def catalog_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each model's outputs, as Spark plans them, are its declared columns in order, and all have lineage."""
    planned = spark.createDataFrame([(m, build(spark, sf_dir, m).columns) for m in MODELS], "model string, planned array<string>")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias(c)
    declared = fx.catalog_columns(spark).groupBy(asset_name(F.col("dataset_urn")).alias("model"), "dataset_urn").agg(ordered("declared"))
    traced = fx.column_edges(spark).groupBy(F.col("down_urn").alias("dataset_urn")).agg(F.sort_array(F.collect_set("down_path")).alias("traced"))
    rows = planned.join(declared, "model").join(traced, "dataset_urn")
    return rows.select("model", F.size("planned").alias("n_columns"), (F.col("planned") == F.col("declared")).alias("declared_same"), (F.sort_array("planned") == F.col("traced")).alias("traced_same"))


def writeback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stand in for write-back actions: one target a user, failed where the value is low."""
    rows = parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), (F.col("user_id") % 20).cast("string").alias("target"),
        (F.col("value") >= 1).alias("ok"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("detail"),
    )
    return writeback.summary(rows)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stand in for a run's log: numbered by user in order of time."""
    rows = parquet(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), events.phase_of(F.col("event_type")).alias("phase"), F.format_string("%012d", "event_id").alias("title")
    )
    return events.number(rows).select("run_id", "seq", "phase", F.col("title").cast("long").alias("event_id"))


def completed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.local(spark, fx.RUNS, fx.RUN_SCHEMA)
    return events.completed_stages(runs).select("run_id", F.array_join("stages", ",").alias("stages"))


def live_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that tables have now, read from their schemas."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    found = snapshot.live_columns(spark, {n: parquet(spark, sf_dir, n) for n in names} | {"absent": None})
    return found.select(F.col("dataset_urn").alias("dataset"), "ordinal", "name", "data_type")


def captured_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' schemas and a known raw table's, after all changes; a known dataset that is gone has no rows."""
    models = fx.local(spark, [(fx.urn(m),) for m in MODELS], "dataset_urn string")
    known = fx.local(spark, [(fx.urn("orders"),), (fx.urn("fct_orders"),), ("gone",)], "dataset_urn string")
    return snapshot.capture(all_changes(spark), models, known).select("dataset_urn", "ordinal", "name", "native_type")


def saved_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared baseline, written and loaded again."""
    path = lineage.shared_path(spark, "snapshot") or tempfile.mkdtemp(prefix="tidemark-")
    snapshot.save(fx.catalog_columns(spark), path)
    return snapshot.load(spark, path)


def analysis_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements Spark resolves on the changed columns, before and after the repair."""
    found, order, as_of = None, [*EXTRACTS, *MODELS], {":as_of": "timestamp_ntz'1998-08-02 00:00:00'", "NUMBER(": "DECIMAL("}
    texts = spark.createDataFrame([(a, 1, sql) for a, sql in (MODELS | EXTRACTS).items()], "asset string, line int, text string")
    for s in SCENARIOS:
        mended = repaired(spark, s)[0].select("asset", "line", "text")
        mended = mended.unionByName(texts.join(mended.select("asset").distinct(), "asset", "left_anti"))
        for state, code in (("before", texts), ("after", mended)):
            one = analysis.analysed(spark, code, live_catalog(spark, s), input_names(spark), order, as_of).select(F.lit(s).alias("scenario"), F.lit(state).alias("state"), "asset", "ok", "object")
            found = one if found is None else found.unionByName(one)
    return found


def declared_docs(spark: SparkSession) -> DataFrame:
    tests = fx.local(spark, fx.test_rows(), "dataset string, column string, test string")
    return tests.groupBy("dataset", "column").agg(F.sort_array(F.collect_list("test")).alias("tests")).withColumn("description", F.concat(F.lit("The "), "column"))


def renamed_docs(spark: SparkSession) -> DataFrame:
    kind, _, old, new = SCENARIOS["rename"]
    models = fx.local(spark, [(m,) for m in MODELS], "dataset string")
    return docs.renamed(declared_docs(spark), models, old, new)


def docs_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed_docs(spark).select("dataset", "column", "description", F.array_join("tests", ",").alias("tests"))


def docs_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = fx.local(spark, [("stg_customers", "MARKETING_OPT_IN"), ("dim_customers", "is_marketable")], "dataset string, column string")
    return docs.dropped(declared_docs(spark), gone).select("dataset", "column")


def generated_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.generated_tests(declared_docs(spark), renamed_docs(spark))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_records(fx.local(spark, fx.RUNS, fx.RUN_SCHEMA))


QUERIES: dict[str, Query] = {name: model_query(name) for name in [*MODELS, *EXTRACTS]} | {
    f.__name__: f
    for f in (
        scan_orders, catalog_columns, list_namespace, captured_queries, drift_retype, drift_removed, drift_added, rename_candidates,
        drift_rename_fast, drift_rename_greedy, drift_drop, drift_add, drift_events, schema_diff_rows, column_edges, table_edges,
        column_impact, table_downstreams, lineage_closure, lineage_paths, graph_edges, shown_edges, flattened_edges, has_outgoing_edge, lineage_disagreement,
        lineage_control, corrected_edges, documentation_targets, dangling_edges, impact_assets, impact_stats, graph_nodes,
        consumed_evidence, reference_locations, reference_checks, validation_summary, validation_gate, repair_patches,
        dq_not_null, dq_unique, catalog_consistency, writeback_summary, run_events, completed_stages,
        live_schema, captured_snapshot, saved_snapshot, analysis_checks, docs_renamed, docs_dropped, generated_tests, run_records,
    )
}

QUERIES |= tables.QUERIES | graphs.QUERIES | markup.QUERIES

ORACLE_SQL: dict[str, str] = {k: v for k, v in ORACLES.items() if k in QUERIES} | tables.ORACLE_SQL | graphs.ORACLE_SQL | markup.ORACLE_SQL
