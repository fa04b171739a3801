"""Properties of the plans that must hold on a large cluster."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import orderloom as ol
from conftest import session_settings
from orderloom.plans.build import with_written_totals
from orderloom.sources.reader import typed_like

# The corpus queries have tests of their own, beside their package.
CORPUS = set(registered.corpus.QUERIES) if registered.corpus else set()
QUERIES = {name: query for name, query in registered.queries().items() if name not in CORPUS}

SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_pair_joins_and_no_python(spark, small_folder, name):
    plan = plan_of(QUERIES[name](spark, small_folder))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


@pytest.mark.parametrize("name", ol.MARTS)
def test_marts_force_no_broadcast(spark, small_folder, name):
    """Whether a join side is broadcast is left to its measured size."""
    logical = ol.run(name, ol.bind(spark, small_folder))._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in logical


@pytest.mark.parametrize("name", ol.MARTS)
def test_marts_count_distinct_orders_without_expanding_rows(spark, small_folder, name):
    assert "Expand" not in plan_of(ol.run(name, ol.bind(spark, small_folder)))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """One product holds a third of the items, one customer a third of the orders."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    hot = F.when(F.col("id") % 3 == 0, F.lit("0"))
    key = F.col("id").cast("string")
    orders = spark.range(60_000).select(
        key.alias("order_id"),
        hot.otherwise(key).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.lit("2018-01-01").cast("timestamp_ntz").alias("order_purchase_timestamp"),
        F.lit("2018-01-05").cast("timestamp_ntz").alias("order_delivered_customer_date"),
    )
    items = spark.range(60_000).select(
        key.alias("order_id"),
        F.lit(1).alias("order_item_id"),
        hot.otherwise(key).alias("product_id"),
        (F.col("id") % 50).cast("string").alias("seller_id"),
        F.lit(1.5).alias("price"),
        F.lit(0.25).alias("freight_value"),
    )
    members = spark.range(60_000)
    tables = {
        "orders": orders,
        "order_items": items,
        "customers": members.select(key.alias("customer_id"), key.alias("customer_unique_id"), F.lit("SP").alias("customer_state")),
        "products": members.select(key.alias("product_id"), F.lit("a").alias("product_category_name")),
        "sellers": members.where("id < 50").select(key.alias("seller_id")),
        "category_translation": spark.sql("select 'a' as product_category_name, 'x' as product_category_name_english"),
        "order_payments": orders.select("order_id"),
        "order_reviews": orders.select("order_id"),
    }
    shop = ol.Shop(**{name: typed_like(table, name) for name, table in tables.items()})
    ol.land_parquet(shop, folder)
    return ol.read_shop_parquet(spark, folder)


SMALL_SKEW = SHUFFLED | {
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.05",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    "spark.sql.files.maxPartitionBytes": "100k",
    # A partition is split by the tasks that wrote it, so there must be several.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.mark.parametrize(
    "name, revenue, orders",
    [("category_analytics", 105_000.0, 60_000), ("geography_analytics", 105_000.0, 60_000)],
)
def test_large_keys_are_split_over_tasks(spark, skewed, name, revenue, orders):
    with session_settings(spark, SMALL_SKEW):
        frame = ol.run(name, skewed)
        rows = frame.collect()
        assert [(r["revenue"], r["orders"]) for r in rows] == [(revenue, orders)]
        assert "skew=true" in plan_of(frame)


@pytest.mark.parametrize("written", [True, False])
def test_an_order_id_shared_by_many_customers_is_split(spark, skewed, written, tmp_path):
    shared = F.when(F.col("order_id") % 3 == 1, "1").otherwise(F.col("order_id"))
    orders = skewed.orders.withColumn("order_id", shared)
    shop = ol.Shop(**(skewed.tables() | {"orders": orders}))
    shop = with_written_totals(shop, str(tmp_path / "totals")) if written else shop
    with session_settings(spark, SMALL_SKEW):
        mart = ol.run("customer_analytics", shop)
        rows = mart.collect()
        assert sum(r["total_spent"] for r in rows) == 105_000.0
        assert sum(r["orders"] for r in rows) == 60_000
        assert "skew=true" in plan_of(mart)


@pytest.mark.parametrize("hot", ["1", None])
def test_an_order_id_in_many_baskets_is_split(spark, skewed, hot):
    """A third of the sellers' baskets share one order id, or have none."""
    shared = F.when(F.col("order_id") % 3 == 1, F.lit(hot)).otherwise(F.col("order_id"))
    items = skewed.order_items.withColumn("seller_id", F.col("order_id")).withColumn("order_id", shared)
    sellers = skewed.orders.select(F.col("order_id").alias("seller_id"))
    tables = skewed.tables() | {"order_items": items, "sellers": typed_like(sellers, "sellers")}
    with session_settings(spark, SMALL_SKEW):
        mart = ol.run("seller_analytics", ol.Shop(**tables))
        rows = mart.collect()
        assert len(rows) == 60_000 and sum(r["revenue"] for r in rows) == 105_000.0
        assert sum(r["orders"] for r in rows) == (60_000 if hot else 40_000)
        assert "skew=true" in plan_of(mart)
