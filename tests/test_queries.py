import pytest

from tests.support import duck, same
from tidemark.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    same(QUERIES[name](spark, small), duck(small).execute(ORACLE_SQL[name]).df())


def test_unmatched_orders_count_no_items(spark, small):
    assert QUERIES["fct_orders"](spark, small).where("item_count = 0").count() > 0


def test_models_agree_with_their_declarations(spark, small):
    for r in QUERIES["catalog_consistency"](spark, small).collect():
        assert r.declared_same and r.traced_same, r.model


def test_mart_plan_prunes_columns(spark, small):
    plan = QUERIES["mart_daily_revenue"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "o_orderpriority" not in plan
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in plan or "o_orderstatus" in plan


def test_actionable_error_for_a_missing_table(spark):
    from tidemark.sources.warehouse import parquet

    with pytest.raises(FileNotFoundError, match="orders.parquet"):
        parquet(spark, "/nowhere", "orders")


def test_save(spark, small):
    from tidemark.plans.models import save

    save(spark, small, "stg_products")
    save(spark, small, "dim_products")
    assert spark.table("stg_products").count() == spark.table("dim_products").count() > 0
    spark.sql("drop table dim_products")
