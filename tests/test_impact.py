import pytest

from tidemark.operators import impact, lineage, references, repair, validate, writeback
from tidemark.plans import fixtures as fx
from tidemark.plans import queries as q


@pytest.fixture(scope="module")
def assets(spark):
    every = lineage.cut(q.assets(spark))
    return {s: every.where(every.drift == s) for s in q.SCENARIOS}


@pytest.mark.parametrize("scenario, counts", [("rename", (3, 2, 7)), ("retype", (2, 3, 7)), ("drop", (2, 0, 10))])
def test_buckets(assets, scenario, counts):
    s = impact.stats(assets[scenario], assets[scenario]).first()
    assert (s["requires_patch"], s["downstream_unaffected"], s["skipped"]) == counts
    assert s["total_scanned"] == 12 and s["max_hops_reached"] == 3


def test_reasons(assets):
    said = {r["asset"]: r for r in assets["rename"].collect()}
    assert said["stg_orders"]["reason"] == "SQL references `order_placed_at` exactly once on line 7; this lineage-bearing file requires repair."
    assert "exactly 2 times on lines 2, 4" in said["extract_recent_orders"]["reason"]
    assert said["mart_daily_revenue"]["reason"].startswith("Reads `order_date`, aliases created upstream")
    assert "`dim_products` columns {category, product_id, sku}; `stg_order_items` columns {line_total, quantity}" in said["mart_product_performance"]["reason"]
    assert said["stg_customers"]["hops"] == 2  # reached through a job


def test_a_hit_without_code_is_refused(spark):
    code = fx.code_lines(spark).where("asset <> 'fct_orders'")
    with pytest.raises(LookupError, match="fct_orders"):
        impact.classify(code, fx.column_edges(spark), fx.table_edges(spark), fx.catalog_columns(spark), q.starts(spark, "rename"))


def test_control_column_reaches_a_strict_subset(spark):
    reached = {}
    for r in q.lineage_control(spark, "").collect():
        reached.setdefault(r["reached_by"], set()).add(r["urn"])
    assert reached["order_status"] == {fx.urn("stg_orders"), fx.urn("fct_orders")} < reached["order_placed_at"]


def test_agreement(spark):
    rows = [("a", fx.urn("orders"), "order_placed_at"), ("b", fx.urn("orders"), "gross_amount"), ("c", fx.urn("orders"), "currency_code"), ("d", fx.urn("mart_customer_ltv"), "country_code")]
    edges, begin = fx.column_edges(spark), lineage.starts(spark, rows)
    hits = lineage.column_impact(edges, begin).where("drift <> 'b'")
    assert dict(map(tuple, lineage.agreement(edges, hits, begin).collect())) == {"a": "agreed", "b": "missing", "c": "narrowed", "d": "refused"}


def test_cycles_end(spark):
    loop = fx.local(spark, [("a", "X", "b", "y", "I"), ("b", "Y", "a", "x", "I"), ("b", "y", "c", "z", "I")], fx.EDGES)
    assert sorted(map(tuple, lineage.closure(loop, lineage.starts(spark, [("d", "a", "x")])).collect())) == [("d", "b", "y"), ("d", "c", "z")]


def test_column_references(spark):
    rows = [("u", "a", "sql", 1, "select order_placed_at_utc, order_placed_at, count(*) as n, 'order_placed_at' as s"), ("u", "a", "sql", 2, "from t x -- order_placed_at"), ("u", "a", "sql", 3, "where x.Order_Placed_At is not null")]
    refs = references.find(fx.local(spark, rows, fx.CODE))
    assert references.matching(refs, "order_placed_at").count() == 2
    assert {r["name"] for r in refs.collect()} == {"order_placed_at_utc", "order_placed_at", "Order_Placed_At"}


@pytest.mark.parametrize("scenario, counts", [("rename", {"live_catalog": 15, "projected_repair": 6, "local_cte": 2}), ("retype", {"live_catalog": 13}), ("drop", {"live_catalog": 5, "projected_repair": 5})])
def test_repairs_resolve(spark, scenario, counts):
    checked = lineage.cut(q.checked(spark, scenario))
    assert {(r["status"], r["source"]): r["n"] for r in validate.summary(checked).collect()} == {("OK", k): v for k, v in counts.items()}
    assert validate.gate(checked).first()["valid"]


def test_gate_stops_what_is_made_up_or_stale(spark):
    code = fx.code_lines(spark)
    patch = fx.local(spark, [(fx.urn("stg_orders"),)], "asset_urn string")
    from pyspark.sql import functions as F

    odd = code.withColumn("text", F.regexp_replace("text", "order_status,", "definitely_not_a_real_column,"))
    checked = validate.checks(odd, q.live_catalog(spark, "rename"), patch, q.input_names(spark), "RENAME", fx.urn("orders"), "order_placed_at")
    by = {r["column"]: r["status"] for r in checked.collect()}
    assert by["definitely_not_a_real_column"] == "UNKNOWN_COLUMN" and by["order_placed_at"] == "STALE_OLD_NAME"
    assert not validate.gate(checked).first()["valid"]
    assert validate.gate(checked.where("false")).first()["valid"]


def test_only_lines_that_refer_change(spark):
    for scenario in q.SCENARIOS:
        for p in repair.patches(fx.code_lines(spark), q.repaired(spark, scenario)[0]).collect():
            assert p["changed_lines"] <= 2
            assert repair.diff(p["before"].split("\n"), p["after"].split("\n"), p["asset"]).count("\n-") <= 3
    again, patch = q.repaired(spark, "retype")
    assert repair.patches(again, repair.retype(again, patch, "gross_amount", "NUMBER(12,2)")).count() == 0


def test_no_repair_writes_a_source(spark):
    assert {r["asset"] for s in q.SCENARIOS for r in repair.patches(fx.code_lines(spark), q.repaired(spark, s)[0]).collect()}.isdisjoint(fx.RAW_COLUMNS)


def test_writebacks(spark):
    acts = fx.local(spark, [(1, "tag", "a", True, None, "x"), (2, "tag", "a", False, None, "no"), (3, "tag", "a", False, "bad", "y"), (4, "doc", "b", True, None, "z")], "seq int, kind string, target string, ok boolean, error string, detail string")
    got = {r["kind"]: (r["ok"], r["failed"], r["error"]) for r in writeback.summary(acts).collect()}
    assert got == {"tag": (False, 2, "no; bad"), "doc": (True, 0, None)}
    drifts = fx.local(spark, [("d1", "u", "c", None), ("d2", "u", "e", None)], "id string, dataset_urn string, old_column string, new_column string")
    review = fx.local(spark, [("d1", "https://x/1"), ("d2", "dry/run.md")], "drift string, reference string")
    first, second = (sorted(map(tuple, writeback.incidents(drifts, review).collect())) for _ in range(2))
    assert first == second and {(r[1], r[4]) for r in first} == {("d1", "FIXED"), ("d2", "TRIAGE")}
    names = fx.local(spark, [("demo.a",), ("other.b",)], "name string")
    stay, audit = writeback.guarded_delete(names, "demo.")
    assert stay.first()[0] == "other.b" and audit.first()[0] == "demo.a"
    with pytest.raises(ValueError):
        writeback.guarded_delete(names, "")
    edges = fx.column_edges(spark)
    fixed = writeback.reconcile(edges, lineage.corrected(edges, "DROP", "order_placed_at"), fx.local(spark, [(fx.urn("stg_orders"),)], "urn string"))
    assert fixed.count() == 59


def test_an_added_column_has_an_empty_report(spark):
    got = {r["scenario"]: r for r in q.impact_stats(spark, "").collect()}
    assert tuple(got["add"][c] for c in ("requires_patch", "downstream_unaffected", "skipped", "total_scanned", "max_hops_reached")) == (0,) * 5
    assert set(got) == {*q.SCENARIOS, "add"}


def test_many_drifts_at_a_time(spark):
    from pyspark.sql import functions as F

    begin = spark.range(20_000).select(F.concat(F.lit("d"), "id").alias("drift"), F.lit(fx.urn("orders")).alias("urn"), F.when(F.col("id") % 1000 == 7, "order_placed_at").otherwise(F.concat(F.lit("c"), "id")).alias("path"))
    found = lineage.cut(impact.classify(fx.code_lines(spark), fx.column_edges(spark), fx.table_edges(spark), fx.catalog_columns(spark), begin, unreached=False))
    assert found.where("bucket = 'REQUIRES_PATCH'").count() == 3 * 20
    counts = {tuple(r[c] for c in ("requires_patch", "downstream_unaffected", "skipped", "total_scanned", "n")) for r in impact.stats(found, begin, 12).groupBy("requires_patch", "downstream_unaffected", "skipped", "total_scanned").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {(3, 2, 7, 12, 20), (0, 0, 12, 12, 19_980)}


def test_reached_assets_are_those_of_the_whole_report(spark):
    whole, some = (lineage.cut(q.assets(spark, unreached=u)) for u in (True, False))
    assert some.exceptAll(whole).count() == 0
    assert {r["bucket"] for r in whole.exceptAll(some).collect()} == {"SKIPPED"}
    total = impact.universe(fx.code_lines(spark), fx.catalog_columns(spark)).count()
    assert sorted(impact.stats(whole, q.starts(spark)).collect()) == sorted(impact.stats(some, q.starts(spark), total).collect())


def test_shown_edges_have_both_ends(spark):
    shown = {(r["up_urn"], r["down_urn"]) for r in q.shown_edges(spark, "").collect()}
    assert shown == {(fx.urn("orders"), fx.urn("stg_orders")), (fx.urn("stg_orders"), fx.urn("fct_orders"))}


def test_nested_lineage_of_several_columns(spark):
    nested = spark.sql("""select 'd' as dataset_urn, array(
        named_struct('operation', 'SUM', 'upstreams', array(named_struct('urn', 'a', 'path', 'x'), named_struct('urn', 'b', 'path', 'y')),
            'downstreams', array(named_struct('urn', cast(null as string), 'path', 'p'), named_struct('urn', 'e', 'path', 'q'))),
        named_struct('operation', 'NONE', 'upstreams', cast(array() as array<struct<urn:string,path:string>>), 'downstreams', array(named_struct('urn', cast(null as string), 'path', 'r')))) as lineage""")
    got = sorted(map(tuple, lineage.flattened(nested).collect()))
    assert got == [("a", "x", "d", "p", "SUM"), ("a", "x", "e", "q", "SUM"), ("b", "y", "d", "p", "SUM"), ("b", "y", "e", "q", "SUM")]


def code_of(spark, *lines):
    return fx.local(spark, [("u", "a", "sql", i, t) for i, t in enumerate(lines, 1)], fx.CODE), fx.local(spark, [("u",)], "asset_urn string")


def test_repairs_spare_literals_comments_and_longer_names(spark):
    code, patch = code_of(spark, "select o.placed_at, PLACED_AT as x, 'placed_at, placed_at' as s, placed_at_utc -- placed_at", "from t o", "order by placed_at desc limit 5")
    got = [r["text"] for r in repair.rename(code, patch, "placed_at", "made_at").orderBy("line").collect()]
    assert got == ["select o.made_at, MADE_AT as x, 'placed_at, placed_at' as s, placed_at_utc -- placed_at", "from t o", "order by made_at desc limit 5"]
    got = [r["text"] for r in repair.retype(code, patch, "placed_at", "DATE").orderBy("line").collect()]
    assert got[0] == "select CAST(o.placed_at AS DATE) AS placed_at, CAST(PLACED_AT AS DATE) as x, 'placed_at, placed_at' as s, placed_at_utc -- placed_at"
    bare, _ = code_of(spark, "select", "    o.placed_at,", "    id", "from t o")
    got = [r["text"] for r in repair.retype(bare, patch, "placed_at", "DATE").orderBy("line").collect()]
    assert got[1] == "    CAST(o.placed_at AS DATE) AS placed_at,"


def test_a_retyped_item_keeps_its_name_wherever_it_stands(spark):
    code, patch = code_of(spark, "select id, f(id, amount, 1), AMOUNT from (select distinct amount, sum(amount) over (partition by id, amount, k) s from t) u", "where amount > 1 group by id, amount, k")
    got = [r["text"] for r in repair.retype(code, patch, "amount", "N").orderBy("line").collect()]
    assert got == [
        "select id, f(id, CAST(amount AS N), 1), CAST(AMOUNT AS N) AS AMOUNT from (select distinct CAST(amount AS N) AS amount, sum(CAST(amount AS N)) over (partition by id, CAST(amount AS N), k) s from t) u",
        "where CAST(amount AS N) > 1 group by id, CAST(amount AS N), k",
    ]
    again, _ = code_of(spark, *got)
    assert [r["text"] for r in repair.retype(again, patch, "amount", "N").orderBy("line").collect()] == got


def test_retype_gives_the_published_patch(spark):
    after = {p["asset"]: p["after"] for p in repair.patches(fx.code_lines(spark), q.repaired(spark, "retype")[0]).collect()}
    assert "order_placed_at, CAST(gross_amount AS NUMBER(12,2)) AS gross_amount\n" in after["extract_recent_orders"]
    assert "    CAST(gross_amount AS NUMBER(12,2)) AS gross_amount,\n    CAST(gross_amount AS NUMBER(12,2)) - coalesce(discount_amount, 0) as net_amount\n" in after["stg_orders"]


def test_comments_and_quoted_names_are_no_references(spark):
    lines = ["select a, /* a, old */ old -- old", "  , '/* old', \"old\", 'it''s -- old' /* old", "old */ + old as x /* a */ , b /*", " /* old", "'old' */ from t where old = '--' and b = old -- */ old", "/* old"]
    code, patch = code_of(spark, *lines)
    found = references.matching(references.find(code), "old").collect()
    assert sorted((r["line"], r["bare"]) for r in found) == [(1, True), (3, False), (5, False), (5, False)]
    got = [r["text"] for r in repair.rename(code, patch, "old", "new").orderBy("line").collect()]
    assert got == ["select a, /* a, old */ new -- old", lines[1], "old */ + new as x /* a */ , b /*", " /* old", "'old' */ from t where new = '--' and b = new -- */ old", "/* old"]


def test_names_resolve_through_nested_scopes(spark):
    from tidemark.operators import lineage

    lines = [
        "with big as (select b.id, b.total from (select id, total from {t}) b where b.total > 1)",
        "select o.id, s.n, gone, s.id, (select max(x) from {u} where u.key = o.id and total = 1) as top",
        "from big as o",
        "join (select count(*) as n, x from {u} where x in (select y from {v} where y = key and z = id) group by x) s on s.x = o.id",
        "where exists (select * from (select y from {v}) w where w.y = o.total and w.z = 1)",
    ]
    code, patch = code_of(spark, *lines)
    catalog = fx.local(spark, [("t", "id"), ("t", "total"), ("u", "x"), ("u", "key"), ("v", "y")], "dataset_urn string, name string")
    inputs = fx.local(spark, [(x, x) for x in "tuv"], "input string, dataset_urn string")
    got = [(r["line"], r["column"], r["table"], r["status"]) for r in lineage.cut(validate.checks(code, catalog, patch, inputs, "RENAME", "t", "none")).collect()]
    bad = sorted((line, column) for line, column, _, status in got if status != "OK")
    # s has no id, o is out of sight within what is joined, w passes y alone.
    assert bad == [(2, "gone"), (2, "id"), (4, "id"), (4, "z"), (5, "z")]
    held = {(line, column, table) for line, column, table, status in got if status == "OK"}
    assert {(2, "key", "u"), (2, "total", "CTE big"), (4, "key", "u"), (4, "y", "v"), (5, "total", "CTE big"), (2, "id", "CTE big")} <= held
    places = {(r["line"], r["name"], (r["scope"] or "").split("#")[0], "#" in (r["scope"] or "")) for r in references.find(code).collect()}
    assert {p[2:] for p in places if p[:2] == (1, "total")} == {("big", True), ("big", False)}
    assert {p[2:] for p in places if p[:2] == (2, "gone")} == {("", False)} and {p[2:] for p in places if p[:2] == (5, "y")} == {("", True)}


def test_analysis_names_what_is_missing(spark):
    from tidemark.operators import analysis

    code = fx.local(spark, [("u", "a", "sql", 1, "select sum(x) over (partition by y) from {t} where nope in (1, 2)"), ("u", "b", "sql", 1, "select * from {gone}"), ("u", "c", "sql", 1, "select from from")], fx.CODE)
    columns = fx.local(spark, [("t", 1, "x", "NUMBER(12,2)"), ("t", 2, "y", "VARCHAR(9)")], "dataset_urn string, ordinal int, name string, native_type string")
    inputs = fx.local(spark, [("t", "t")], "input string, dataset_urn string")
    got = {r["asset"]: r for r in analysis.analysed(spark, code, columns, inputs, ["a", "b", "c"]).collect()}
    assert (got["a"]["ok"], got["a"]["object"]) == (False, "nope") and got["a"]["condition"].startswith("UNRESOLVED_COLUMN")
    assert got["b"]["object"] == "gone" and not got["c"]["ok"]


def test_snapshots(spark, tmp_path):
    from tidemark.operators import drift, snapshot

    with pytest.raises(FileNotFoundError, match="baseline"):
        snapshot.load(spark, str(tmp_path / "none"))
    snapshot.save(fx.catalog_columns(spark), str(tmp_path / "base"))
    events = drift.detect(snapshot.load(spark, str(tmp_path / "base")), q.live_catalog(spark, "rename"))
    assert [r["id"] for r in events.collect()] == ["rename-orders-order_placed_at"]
    assert snapshot.live_columns(spark, {"x": None}).count() == 0


def test_other_writebacks(spark):
    columns = fx.local(spark, [("d", "a", "old"), ("d", "b", None)], "dataset_urn string, name string, description string")
    notes = fx.local(spark, [("d", "b", "new")], "dataset_urn string, name string, description string")
    assert sorted(map(tuple, writeback.document(columns, notes).collect())) == [("d", "a", "old"), ("d", "b", "new")]
    tags = fx.local(spark, [("d", "a", "t")], "urn string, field string, tag string")
    assert writeback.tag(tags, tags.union(fx.local(spark, [("d", "b", "t")], "urn string, field string, tag string"))).count() == 2
    known, added = (fx.local(spark, r, "urn string, url string, label string") for r in ([("d", "http://x", "first")], [("d", "http://x", "second"), ("d", "http://y", "other")]))
    assert sorted(map(tuple, writeback.links(known, added).collect())) == [("d", "http://x", "first"), ("d", "http://y", "other")]
