"""Marts against plain Python on a shop with repeated, missing, unknown and very frequent keys."""

import pytest
from pyspark.sql import functions as F

import dirty
import orderloom as ol
from conftest import session_settings
from orderloom.operators.facts import order_totals
from orderloom.plans.registry import run_sorted


@pytest.fixture(scope="module")
def tables():
    return dirty.rows()


@pytest.fixture(scope="module")
def shop(spark, tables):
    return dirty.shop(spark, tables)


def collected(frame, keys):
    found = {}
    for row in frame.collect():
        values = row.asDict()
        key = tuple(values.pop(k) for k in keys)
        assert key not in found
        found[key[0] if len(keys) == 1 else key] = values
    return found


def check(frame, name, tables):
    actual = collected(frame, dirty.KEYS[name])
    expected = dirty.EXPECTED[name](tables)
    assert actual.keys() == expected.keys()
    for key, values in expected.items():
        assert actual[key].keys() == values.keys()
        for column, value in values.items():
            assert actual[key][column] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value), (
                key,
                column,
            )


@pytest.mark.parametrize("name", dirty.EXPECTED)
def test_mart_equals_plain_python(shop, tables, name):
    check(ol.run(name, shop), name, tables)


@pytest.mark.parametrize("name", ["monthly_metrics", "customer_analytics", "geography_analytics"])
def test_mart_over_written_totals(spark, shop, tables, name, tmp_path):
    order_totals(shop.order_items).write.parquet(str(tmp_path / "totals"))
    staged = shop.with_order_totals(spark.read.parquet(str(tmp_path / "totals")))
    check(ol.run(name, staged), name, tables)


@pytest.mark.parametrize("name", dirty.EXPECTED)
def test_mart_does_not_depend_on_join_strategy(spark, shop, tables, name):
    """Without broadcasts, and with thresholds low enough that skewed partitions are split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100",
    }
    with session_settings(spark, settings):
        check(ol.run(name, shop), name, tables)


def test_sum_of_months_is_the_sum_of_orders(spark, small_folder):
    shop = ol.bind(spark, small_folder)
    months = ol.run("monthly_metrics", shop)
    assert months.agg(F.sum("orders")).first()[0] == shop.orders.select("order_id").distinct().count()


@pytest.mark.parametrize(
    "name, dimension, key",
    [
        ("product_analytics", "products", "product_id"),
        ("seller_analytics", "sellers", "seller_id"),
        ("customer_analytics", "customers", "customer_id"),
    ],
)
def test_every_member_is_present_once(spark, small_folder, name, dimension, key):
    shop = ol.bind(spark, small_folder)
    mart = ol.run(name, shop).select(key)
    members = shop.table(dimension).select(key)
    assert mart.count() == mart.distinct().count() == members.count()
    assert mart.exceptAll(members).count() == 0


def test_sorted_marts_have_missing_keys_last(shop):
    states = [r["state"] for r in run_sorted("geography_analytics", shop).collect()]
    assert states == ["MG", "RJ", "SP", "XX", None]
    names = [(r["category"], r["category_english"]) for r in run_sorted("category_analytics", shop).collect()]
    assert names == sorted(names, key=lambda n: (n[0], n[1] is None, n[1]))


def test_unknown_query_is_an_error(shop):
    with pytest.raises(KeyError, match="unknown query"):
        ol.run("nope", shop)


def test_category_named_like_another_one_in_english_keeps_both_rows(spark, tables):
    """Untranslated 'y' and 'b' translated to 'y' are two rows with one name."""
    rows = [r for r in ol.run("category_analytics", dirty.shop(spark, tables)).collect() if r["category"] == "y"]
    assert sorted(str(r["category_english"]) for r in rows) == ["None", "y"]
