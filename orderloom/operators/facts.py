"""Aggregates that shrink a fact table to the grain a mart joins on.

Each one groups before any join, so a key that holds a large share of the rows
is combined on the map side and crosses the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.moments import days_between, zoneless
from orderloom.functions.money import sum_amounts

# SQL for the days from purchase to delivery.
DELIVERY_DAYS = days_between(zoneless("order_purchase_timestamp"), zoneless("order_delivered_customer_date"))

# How many rows fell into the group, so that joins can count each of them.
COPIES = "count(1) as copies"


def exprs(*texts: str) -> list[Column]:
    return [F.expr(text) for text in texts]


def order_totals(items: DataFrame, splittable: bool = False) -> DataFrame:
    """Per order: exact totals ``price``, ``freight`` and their sum ``revenue``.

    ``splittable`` totals are grouped on a second, dependent key, so a join on
    the order shuffles them once more. Adaptive execution splits a skewed join
    only when both sides come straight from such a shuffle.
    """
    if splittable:
        spread = items.withColumn("spread", F.hash("order_id"))
        return _totals_by(spread, "order_id", "spread").drop("spread")
    return _totals_by(items, "order_id")


def _totals_by(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(
        *sum_amounts("price", "price"),
        *sum_amounts("freight", "freight_value"),
        *sum_amounts("revenue", "price", "freight_value"),
    )


def review_scores(reviews: DataFrame) -> DataFrame:
    """Per order: sum and number of its review scores, whose quotient is their mean."""
    return reviews.groupBy("order_id").agg(*exprs("sum(review_score) as scores", "count(review_score) as n_scores"))


def category_names(translations: DataFrame) -> DataFrame:
    """One English name per category: the smallest, when several are given."""
    return translations.groupBy("product_category_name").agg(
        *exprs("min(product_category_name_english) as product_category_name_english")
    )


def product_names(products: DataFrame, translations: DataFrame) -> DataFrame:
    """Product id with its category and English category; products are not deduplicated."""
    return products.select("product_id", "product_category_name").join(
        category_names(translations), "product_category_name", "left"
    )
