"""Nested order documents; every child of an order is in its document."""

import pytest
from pyspark.sql import functions as F

import dirty
from orderloom.operators.documents import order_documents, typed_reviews
from orderloom.sources.shop import Shop
from orderloom.plans.aggregates import orders_by_status, payments_by_type, unwound_payments_by_type


@pytest.fixture(scope="module")
def shop(spark):
    tables = dirty.rows()
    seen, unique = set(), []
    for order in tables["orders"]:
        if order["order_id"] is not None and order["order_id"] not in seen:
            seen.add(order["order_id"])
            unique.append(order)
    return dirty.shop(spark, tables | {"orders": unique})


CHILDREN = {"items": "order_items", "payments": "order_payments", "reviews": "order_reviews"}


def expected_children(shop, array):
    child = shop.table(CHILDREN[array])
    return child.join(shop.orders.select("order_id"), "order_id", "left_semi")


@pytest.mark.parametrize("array", CHILDREN)
def test_unwinding_gives_back_every_child_of_a_known_order(shop, array):
    actual = order_documents(shop).unwind(array)
    expected = expected_children(shop, array).select(*actual.columns)
    assert actual.exceptAll(expected).count() == expected.exceptAll(actual).count() == 0


def test_one_document_per_order_with_empty_arrays(shop):
    built = order_documents(shop)
    assert built.documents.count() == shop.orders.count()
    assert built.documents.where("items is null or payments is null or reviews is null").isEmpty()
    assert not built.documents.where("size(payments) = 0").isEmpty()
    assert built.documents.columns[:3] == ["_id", "customer_id", "order_status"]
    assert "order_id" not in built.documents.select(F.explode("items").alias("e")).select("e.*").columns


def test_a_large_order_keeps_all_children(spark, shop):
    one = shop.orders.where("order_id is not null").first()["order_id"]
    many = spark.range(30_000).selectExpr(
        f"'{one}' as order_id", "id as order_item_id", "'p' as product_id", "'s' as seller_id",
        "timestamp_ntz'2024-01-01 00:00:00' as shipping_limit_date", "1D as price", "cast(null as double) as freight_value",
    )
    tables = shop.tables() | {"order_items": many.select(shop.order_items.columns)}
    document = order_documents(Shop(**tables)).documents.where(F.col("_id") == one).first()
    assert [e["order_item_id"] for e in document["items"]] == list(range(30_000))


def test_elements_are_in_order(shop):
    documents = order_documents(shop).documents
    ids = documents.select("items.order_item_id").collect()
    assert all(r[0] == sorted(r[0]) for r in ids)


def test_orders_without_payments_vanish_when_unwound(shop):
    built = order_documents(shop)
    without = built.documents.where("size(payments) = 0").select(F.col("_id").alias("order_id"))
    assert built.unwind("payments").join(without, "order_id", "left_semi").isEmpty()


def test_payments_by_type_from_tables_and_from_documents(shop):
    from_tables = payments_by_type(shop.order_payments, shop.orders).collect()
    from_documents = unwound_payments_by_type(order_documents(shop).unwind("payments")).collect()
    assert from_tables == from_documents
    assert [r["payment_type"] for r in from_tables].count(None) == 1


def test_payments_are_rounded_half_to_even_and_sorted_by_total(spark):
    columns = "order_id string, payment_sequential bigint, payment_type string, payment_value double"
    payments = spark.createDataFrame(
        [
            ("o1", 1, "even", 0.125),
            ("o1", 2, "odd", 0.375),
            ("o1", 3, "none", None),
            ("o1", 4, None, 7.0),
            ("unknown", 1, "odd", 1000.0),
        ],
        columns,
    )
    orders = spark.createDataFrame([("o1",), ("o1",)], "order_id string")
    found = [tuple(r) for r in payments_by_type(payments, orders).collect()]
    assert found == [
        (None, 1, 7.0, 7.0),
        ("odd", 1, 0.38, 0.38),
        ("even", 1, 0.12, 0.12),
        ("none", 1, 0.0, None),
    ]


def test_orders_by_status_is_sorted_with_a_tie_break(spark):
    orders = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "order_status string")
    found = [tuple(r) for r in orders_by_status(orders).collect()]
    assert found == [("c", 2), (None, 1), ("a", 1), ("b", 1)]


def test_review_times_move_to_the_end(shop):
    columns = typed_reviews(shop.order_reviews).columns
    assert columns[-2:] == ["review_creation_date", "review_answer_timestamp"]
    assert sorted(columns) == sorted(shop.order_reviews.columns)
