"""Nested order documents: an order with its items, payments and reviews as arrays.

Every child of an order is in its array, however many there are: an order is one
row, and one that no row can hold fails loudly instead of losing children. To read
children by themselves, use their tables, which are not nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.moments import zoneless
from orderloom.sources.shop import Shop

# How the elements of each array are ordered.
ELEMENT_ORDER = {
    "items": ["order_item_id"],
    "payments": ["payment_sequential"],
    "reviews": ["review_creation_date", "review_id"],
}

ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


@dataclass(frozen=True)
class OrderDocuments:
    """``documents``: one row per order, with all its children."""

    documents: DataFrame

    def unwind(self, array: str) -> DataFrame:
        """One row per element of ``array``; orders without elements vanish."""
        return unwind(self.documents, array)


def unwind(documents: DataFrame, array: str) -> DataFrame:
    """``(order_id, element fields...)`` of a nested array."""
    element = F.explode(array).alias("element")
    return documents.select(F.col("_id").alias("order_id"), element).select("order_id", "element.*")


def typed_orders(orders: DataFrame) -> DataFrame:
    """The eight order columns with their times as zone-less timestamps."""
    return orders.selectExpr(
        "order_id", "customer_id", "order_status", *[f"{zoneless(c)} as {c}" for c in ORDER_TIMES]
    )


def typed_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their two times cast and moved to the end."""
    times = ["review_creation_date", "review_answer_timestamp"]
    kept = [c for c in reviews.columns if c not in times]
    return reviews.selectExpr(*kept, *[f"{zoneless(c)} as {c}" for c in times])


def _children(shop: Shop) -> dict[str, DataFrame]:
    return {
        "items": shop.order_items,
        "payments": shop.order_payments,
        "reviews": typed_reviews(shop.order_reviews),
    }


def _nest(child: DataFrame, array: str) -> DataFrame:
    """Per order, an array of the child's other columns in a fixed order."""
    fields = [c for c in child.columns if c != "order_id"]
    first = ELEMENT_ORDER[array]
    sortable = ", ".join(first + [c for c in fields if c not in first])
    element = ", ".join(f"'{c}', e.`{c}`" for c in fields)
    ordered = f"array_sort(collect_list(struct({sortable})))"
    return child.groupBy("order_id").agg(F.expr(f"transform({ordered}, e -> named_struct({element})) as {array}"))


def by_customer_newest_first(key: str) -> list[Column]:
    """Sort order of the order table: customer, newest order, key."""
    return [
        F.asc_nulls_first("customer_id"),
        F.desc_nulls_last("order_purchase_timestamp"),
        F.asc_nulls_first(key),
    ]


def order_documents(shop: Shop, files: int | None = None) -> OrderDocuments:
    """Assemble the order documents. Order ids should be unique in the orders table.

    With ``files``, documents carry the number of the ``file`` they belong to
    when the table is cut into that many ranges of customer, time and key. The
    ranges are cut on the narrow orders, before the arrays are joined.
    """
    documents = typed_orders(shop.orders)
    if files is not None:
        ranges = documents.repartitionByRange(files, *by_customer_newest_first("order_id"))
        documents = ranges.withColumn("file", F.spark_partition_id())
    for array, child in _children(shop).items():
        nested = _nest(child.where("order_id is not null"), array)
        documents = documents.join(nested, "order_id", "left")
    # Empty arrays where an order has no children of a kind.
    arrays = {array: F.coalesce(array, F.array()) for array in ELEMENT_ORDER}
    return OrderDocuments(documents.withColumns(arrays).withColumnRenamed("order_id", "_id"))
