from difflib import SequenceMatcher

import pytest

from tidemark.functions import names
from tidemark.operators import drift, matching
from tidemark.plans import fixtures as fx

URN = fx.urn("orders")
SCHEMA = "dataset_urn string, ordinal int, name string, native_type string"


def snapshot(spark, *columns, urn=URN):
    return fx.local(spark, [(urn, i, n, t) for i, (n, t) in enumerate(columns, 1)] or [("none", 1, "x", "x")], SCHEMA)


def found(spark, before, after):
    rows = drift.detect(snapshot(spark, *before), snapshot(spark, *after)).collect()
    return {r["id"]: r for r in rows}


def test_one_for_one_of_a_type_is_a_rename(spark):
    events = found(spark, [("id", "NUMBER"), ("order_placed_at", "TS")], [("id", "NUMBER"), ("order_created_at", "TS")])
    event = events["rename-orders-order_placed_at"]
    assert event["confidence"] == 0.95
    assert "same ordinal position (2)" in event["rationale"]


def test_unlike_names_are_still_a_rename_one_for_one(spark):
    assert [e["kind"] for e in found(spark, [("abc", "T"), ("k", "T")], [("xyz", "T"), ("k", "T")]).values()] == ["RENAME"]


def test_one_for_one_of_other_type_is_drop_and_add(spark):
    events = found(spark, [("k", "T"), ("amount", "NUMBER")], [("k", "T"), ("amounts", "VARCHAR")])
    assert sorted(e["kind"] for e in events.values()) == ["ADD", "DROP"]


def test_several_at_once(spark):
    events = found(spark, [("id", "N"), ("placed_at", "TS")], [("id", "N"), ("created_at", "TS"), ("new_flag", "BOOLEAN")])
    assert sorted(e["kind"] for e in events.values()) == ["ADD", "RENAME"]
    assert events["rename-orders-placed_at"]["new_column"] == "created_at"
    assert events["rename-orders-placed_at"]["confidence"] <= 0.9


def test_two_renames(spark):
    events = found(spark, [("customer_email", "V"), ("billing_zip", "V")], [("customer_mail", "V"), ("billing_postcode", "V")])
    assert {(e["old_column"], e["new_column"]) for e in events.values()} == {("customer_email", "customer_mail"), ("billing_zip", "billing_postcode")}


def test_best_pairs_go_first_when_bests_collide(spark):
    before, after = [("ab_one", "T"), ("ab_two", "T"), ("k", "T")], [("ab_onee", "T"), ("zz", "T"), ("k", "T")]
    events = found(spark, before, after)
    assert events["rename-orders-ab_one"]["new_column"] == "ab_onee"
    assert events["drop-orders-ab_two"]["kind"] == "DROP"


def test_retype_drop_none(spark):
    assert list(found(spark, [("a", "NUMBER(12,2)")], [("a", "VARCHAR(20)")])) == ["retype-orders-a"]
    assert list(found(spark, [("a", "T"), ("b", "T")], [("a", "T")])) == ["drop-orders-b"]
    assert found(spark, [("a", "T")], [("a", "T")]) == {}


def test_missing_and_new_datasets_take_no_part(spark):
    other = fx.urn("customers")
    assert drift.detect(snapshot(spark, ("a", "T")), snapshot(spark, ("b", "T"), urn=other)).count() == 0


@pytest.mark.parametrize("a, b, ratio", [("order_placed_at", "order_created_at", 0.7742), ("placed_at", "created_at", 0.6316), ("placed_at", "new_flag", 0.2353), ("customer_email", "customer_mail", 0.963), ("billing_zip", "billing_postcode", 0.6667)])
def test_similarity(spark, a, b, ratio):
    got = fx.local(spark, [(a, b)], "a string, b string").select(matching.similarity("a", "b")).first()[0]
    assert got == SequenceMatcher(None, a, b).ratio() == pytest.approx(ratio, abs=1e-4)


def test_declare_and_select(spark):
    rows = fx.local(spark, [("DROP", URN, "legacy", None, "T", None)], "kind string, dataset_urn string, old_column string, new_column string, old_type string, new_type string")
    events = drift.declare(rows)
    assert drift.select_event(events, "drop-orders-legacy").first()["rationale"].endswith("`legacy` was dropped.")
    with pytest.raises(LookupError, match="drop-orders-legacy"):
        drift.select_event(events, "nothing")


def test_simulate_keeps_the_baseline(spark):
    base = fx.catalog_columns(spark)
    gone = drift.simulate(base, "DROP", fx.urn("customers"), "full_name")
    assert gone.where(f"dataset_urn = '{fx.urn('customers')}'").orderBy("ordinal").select("ordinal", "name").collect()[2] == (3, "signup_date")
    assert base.count() == 87 and gone.count() == 86


def test_names(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.lit("  Ab C!!").alias("t"), F.lit(URN).alias("u"), F.lit(fx.urn("run_dbt_marts")).alias("j"))
    got = one.select(names.slug(F.col("t")), names.dataset_name(F.col("u")), names.asset_name(F.col("u")), names.asset_name(F.col("j")), names.entity_url("http://x/", F.col("u"))).first()
    assert got[:4] == ("ab-c", "shop_prod.raw.orders", "orders", "run_dbt_marts")
    assert got[4].startswith("http://x/dataset/urn%3Ali")
    with pytest.raises(Exception, match="not a dataset urn"):
        one.select(names.dataset_name(F.col("j"))).collect()
    assert [names.safe_reference(x) for x in ("https://a/b", "x/y.md", "/etc", "~/a", "a/../b", "file:///a", "")] == [True, True, False, False, False, False, False]
