"""Named queries over the role tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators.documents import typed_orders, typed_reviews
from orderloom.operators.loads import products_enriched
from orderloom.plans import marts
from orderloom.sources.shop import Shop

QUERIES: dict[str, Callable[[Shop], DataFrame]] = {
    "customers": lambda shop: shop.customers,
    "sellers": lambda shop: shop.sellers,
    "products": lambda shop: products_enriched(shop.products, shop.category_translation),
    "orders": lambda shop: typed_orders(shop.orders),
    "order_items": lambda shop: shop.order_items,
    "order_payments": lambda shop: shop.order_payments,
    "order_reviews": lambda shop: typed_reviews(shop.order_reviews),
    "monthly_metrics": marts.monthly_metrics,
    "product_analytics": marts.product_analytics,
    "category_analytics": marts.category_analytics,
    "seller_analytics": marts.seller_analytics,
    "customer_analytics": marts.customer_analytics,
    "geography_analytics": marts.geography_analytics,
}


# What the rows of a mart are sorted by when it is shown.
MART_ORDER: dict[str, tuple[str, ...]] = {
    "monthly_metrics": ("month",),
    "product_analytics": ("product_id",),
    "category_analytics": ("category", "category_english"),
    "seller_analytics": ("seller_id",),
    "customer_analytics": ("customer_id",),
    "geography_analytics": ("state",),
}


def run(name: str, shop: Shop) -> DataFrame:
    """The query ``name`` over ``shop``; an unknown name is a ``KeyError``.

    Rows come in no particular order, as a written table needs none.
    """
    if name not in QUERIES:
        raise KeyError(f"unknown query: {name}; known: {', '.join(QUERIES)}")
    return QUERIES[name](shop)


def run_sorted(name: str, shop: Shop) -> DataFrame:
    """A mart in key order, rows without key last."""
    return run(name, shop).orderBy(*[F.asc_nulls_last(c) for c in MART_ORDER[name]])
