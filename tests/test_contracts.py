"""Normalisation and contracts."""

from datetime import datetime

import pytest
from pyspark.sql import types as T

import orderloom as ol
from orderloom.operators.contracts import (
    ENTITIES,
    MARTS,
    ORDER_STATUSES,
    conform,
    conform_orders,
    entity_violations,
    normalize,
    order_violations,
)


def only(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_missing_numbers_of_a_mart_row(spark):
    columns = (
        "_id string, total_orders string, units_sold double, revenue double, freight_revenue double,"
        " avg_price double, unique_sellers bigint"
    )
    some = spark.createDataFrame([("lamp", "3", 4.0, None, 1.25, None, 2), ("rug", " 7 ", None, 30.5, None, 4.5, None)], columns)
    found = {r["_id"]: r.asDict() for r in normalize(some, MARTS["product_analytics"]).collect()}
    lamp, rug = found["lamp"], found["rug"]
    assert (lamp["total_orders"], lamp["units_sold"], lamp["unique_sellers"]) == (3, 4, 2)
    assert (lamp["revenue"], lamp["freight_revenue"], lamp["avg_price"]) == (0.0, 1.25, None)
    assert (rug["units_sold"], rug["unique_sellers"], rug["freight_revenue"]) == (0, 0, 0.0)
    assert (rug["revenue"], rug["avg_price"]) == (30.5, 4.5)


def test_only_categories_have_a_fallback_key(spark):
    row = spark.createDataFrame([(None, 0, 0, None)], "_id string, orders bigint, units_sold bigint, revenue double")
    assert only(normalize(row, MARTS["category_analytics"]))["_id"] == "uncategorized"
    assert only(normalize(row, MARTS["geography_analytics"]))["_id"] is None


def test_no_orders_means_no_numbers_but_keeps_times(spark):
    row = spark.createDataFrame(
        [("c1", "0", 12.5, 3.0, "2024-01-01T00:00:00Z")],
        "_id string, orders string, total_spent double, avg_order_value double, first_order string",
    )
    found = only(normalize(row, MARTS["customer_analytics"]))
    assert (found["orders"], found["total_spent"], found["avg_order_value"]) == (0, 0.0, None)
    assert found["first_order"] == datetime(2024, 1, 1)
    assert found["last_order"] is None


def test_text_and_broken_numbers_are_read(spark):
    row = spark.createDataFrame(
        [("s", " 3 ", "1.5", float("inf"), float("nan"), "x", 2.9)],
        "_id string, orders string, revenue string, freight_revenue double, avg_order_value double,"
        " avg_delivery_days string, delivered_orders double",
    )
    found = only(normalize(row, MARTS["seller_analytics"]))
    assert found == {
        "_id": "s",
        "orders": 3,
        "revenue": 1.5,
        "freight_revenue": 0.0,
        "avg_order_value": None,
        "avg_delivery_days": None,
        "delivered_orders": 2,
    }


@pytest.mark.parametrize("name", MARTS)
def test_marts_fit_their_contract(spark, small_folder, name):
    contract = MARTS[name]
    mart = ol.run(name, ol.bind(spark, small_folder))
    shaped = conform(normalize(mart, contract), contract)
    assert shaped.columns[0] == "_id" and contract.key not in shaped.columns
    assert [(f.name, f.dataType) for f in shaped.schema] == [(f.name, f.dataType) for f in contract.schema]
    assert shaped.count() == mart.count()


def test_absent_fields_take_their_defaults(spark):
    row = spark.createDataFrame([("p",)], "product_id string")
    found = only(conform(row, MARTS["product_analytics"]))
    assert found["_id"] == "p"
    assert (found["total_orders"], found["revenue"], found["avg_price"]) == (0, 0.0, None)


def test_entities(spark):
    customer = spark.createDataFrame(
        [("c", "u", "01037", "city", "SP")],
        "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string,"
        " customer_state string",
    )
    assert only(conform(customer, ENTITIES["customers"]))["customer_zip_code_prefix"] == 1037
    product = spark.createDataFrame([("p", 30)], "product_id string, product_length_cm bigint")
    shaped = conform(product, ENTITIES["products"])
    assert shaped.schema["product_length_cm"].dataType == T.DoubleType()
    assert only(shaped)["product_name_lenght"] is None


def test_entity_violations(spark):
    sellers = spark.createDataFrame(
        [("s1", "01037", "city", "SP"), ("s2", "zip", None, "SP"), (None, "1", "city", "SP")],
        "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    )
    found = {tuple(r) for r in entity_violations(sellers, ENTITIES["sellers"]).collect()}
    assert found == {
        ("s2", "missing seller_zip_code_prefix"),
        ("s2", "missing seller_city"),
        (None, "missing _id"),
    }


def test_order_contract(spark):
    columns = (
        "_id bigint, customer_id bigint, order_status string, order_purchase_timestamp string,"
        " order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz,"
        " order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz,"
        " items array<struct<price:double>>, payments array<struct<v:double>>, reviews array<struct<s:int>>"
    )
    good = [(i, 1, s, "2024-01-01", None, None, None, None, [], [], []) for i, s in enumerate(ORDER_STATUSES)]
    bad = [
        (90, None, "lost", None, None, None, None, None, None, [], []),
        (91, 1, None, None, None, None, None, None, [], [], []),
    ]
    documents = spark.createDataFrame(good + bad, columns)
    found = {tuple(r) for r in order_violations(documents).collect()}
    assert found == {
        (90, "missing customer"),
        (90, "unknown status"),
        (90, "missing items"),
        (91, "unknown status"),
    }
    shaped = conform_orders(documents)
    assert shaped.schema["_id"].dataType == T.StringType()
    assert shaped.first()["order_purchase_timestamp"] == datetime(2024, 1, 1)
