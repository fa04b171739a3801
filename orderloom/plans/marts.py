"""The six analytic marts, one row per key.

Distinct orders are counted by grouping on ``(key, order)`` first and counting
the groups afterwards: no row is expanded once per distinct count, and each
shuffle carries partially aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderloom.functions.moments import month_start, zoneless
from orderloom.functions.money import sum_amounts, sum_totals, total
from orderloom.operators.facts import (
    COPIES,
    DELIVERY_DAYS,
    category_names,
    exprs,
    order_totals,
    product_names,
    review_scores,
)
from orderloom.sources.shop import Shop

# English name first. A translated category is its own English name, so one
# name and a flag cross the shuffles instead of two names.
CATEGORY = (
    "coalesce(product_category_name_english, product_category_name, 'uncategorized') as category",
    "product_category_name_english is not null as translated",
)


def _totals(shop: Shop, splittable: bool = False) -> DataFrame:
    if shop.order_totals is not None:
        return shop.order_totals
    return order_totals(shop.order_items, splittable)


def monthly_metrics(shop: Shop) -> DataFrame:
    """Orders, revenue, delivery time and review score by month of purchase."""
    # Repeated rows of an order collapse here, so the joins below meet at most
    # one row per order and month.
    by_order = (
        shop.orders.selectExpr(
            "order_id",
            f"{month_start(zoneless('order_purchase_timestamp'))} as month",
            "order_status",
            f"{DELIVERY_DAYS} as days",
        )
        .groupBy("order_id", "month")
        .agg(
            *exprs(
                COPIES,
                "max(if(order_status = 'delivered', 1, 0)) as delivered",
                "max(if(order_status = 'canceled', 1, 0)) as canceled",
                "sum(days) as days",
                "count(days) as deliveries",
            )
        )
    )
    by_month = (
        by_order.join(_totals(shop), "order_id", "left")
        .join(review_scores(shop.order_reviews), "order_id", "left")
        # Means of as many scores add up as whole numbers, so the mean of all means
        # is that of a few quotients in a fixed order.
        .groupBy("month", "n_scores")
        .agg(
            *exprs(
                "count(order_id) as orders",
                "sum(if(order_id is not null, delivered, 0)) as delivered_orders",
                "sum(if(order_id is not null, canceled, 0)) as cancelled_orders",
                "sum(days) as days",
                "sum(deliveries) as deliveries",
                "sum(scores * copies) as scores",
                "sum(if(n_scores > 0, copies, 0)) as reviewed",
            ),
            *sum_totals("revenue", times="copies"),
            *sum_totals("freight", times="copies"),
        )
        .groupBy("month")
        .agg(
            *exprs(
                *[f"sum({c}) as {c}" for c in ("orders", "delivered_orders", "cancelled_orders", "days", "deliveries", "reviewed")],
                "array_sort(collect_list(if(n_scores > 0, struct(n_scores, scores / n_scores as mean), null))) as means",
            ),
            *sum_totals("revenue"),
            *sum_totals("freight"),
        )
    )
    return by_month.selectExpr(
        "month",
        "orders",
        "delivered_orders",
        "cancelled_orders",
        f"{total('revenue')} as revenue",
        f"{total('freight')} as freight",
        f"try_divide({total('revenue')}, orders) as avg_order_value",
        "try_divide(days, deliveries) as avg_delivery_days",
        "try_divide(aggregate(means, 0D, (total, m) -> total + m.mean), reviewed) as avg_review_score",
    )


def product_analytics(shop: Shop) -> DataFrame:
    """Sales of every product, sold or not."""
    sales = (
        shop.order_items.groupBy("product_id", "order_id")
        .agg(
            *exprs("count(1) as units"),
            *sum_amounts("price", "price"),
            *sum_amounts("freight", "freight_value"),
        )
        .groupBy("product_id")
        .agg(
            *exprs("count(order_id) as total_orders", "sum(units) as units"),
            *sum_totals("price"),
            *sum_totals("freight"),
        )
    )
    offers = (
        shop.order_items.select("product_id", "seller_id")
        .distinct()
        .groupBy("product_id")
        .agg(*exprs("count(seller_id) as unique_sellers"))
    )
    names = ["product_id", "product_category_name", "product_category_name_english"]
    products = product_names(shop.products, shop.category_translation).groupBy(names).agg(*exprs(COPIES))
    return (
        products.join(sales, "product_id", "left")
        .join(offers, "product_id", "left")
        .selectExpr(
            *names,
            "coalesce(total_orders, 0) as total_orders",
            "coalesce(units * copies, 0) as units_sold",
            f"{total('price', 'freight', times='copies')} as revenue",
            f"{total('freight', times='copies')} as freight_revenue",
            f"if(total_orders > 0, {total('price')} / units, null) as avg_price",
            "coalesce(unique_sellers, 0) as unique_sellers",
        )
    )


def category_analytics(shop: Shop) -> DataFrame:
    """Sales by category, English name first; categories without sales are kept."""
    dimension = (
        product_names(shop.products, shop.category_translation)
        .selectExpr("product_id", *CATEGORY)
        .groupBy("product_id", "category", "translated")
        .agg(*exprs(COPIES))
    )
    # Both sides reach this join straight from a shuffle, so adaptive execution
    # can split a product that holds a large share of the items.
    sales = (
        shop.order_items.select("product_id", "order_id", "price", "freight_value")
        .join(dimension, "product_id")
        .groupBy("category", "translated", "order_id")
        .agg(
            *exprs("sum(copies) as units"),
            *sum_amounts("price", "price", times="copies"),
            *sum_amounts("freight", "freight_value", times="copies"),
        )
        .groupBy("category", "translated")
        .agg(
            *exprs("count(order_id) as orders", "sum(units) as units"),
            *sum_totals("price"),
            *sum_totals("freight"),
        )
    )
    return (
        _categories(shop)
        .join(sales, ["category", "translated"], "left")
        .selectExpr(
            "category",
            "if(translated, category, null) as category_english",
            "coalesce(orders, 0) as orders",
            "coalesce(units, 0) as units_sold",
            f"{total('price', 'freight')} as revenue",
            f"{total('freight')} as freight_revenue",
            f"if(orders > 0, {total('price')} / units, null) as avg_price",
        )
    )


def _categories(shop: Shop) -> DataFrame:
    """Every ``(category, translated)`` of the products.

    Products are reduced to their categories first, so only one row per
    category meets the translations.
    """
    return (
        shop.products.select("product_category_name")
        .distinct()
        .join(category_names(shop.category_translation), "product_category_name", "left")
        .selectExpr(*CATEGORY)
        .distinct()
    )


def seller_analytics(shop: Shop) -> DataFrame:
    """Every seller's own lines; items of unknown orders count, unknown sellers do not."""
    baskets = shop.order_items.groupBy("seller_id", "order_id").agg(
        *sum_amounts("price", "price"), *sum_amounts("freight", "freight_value")
    )
    # Grouped on a second, dependent key, so that the join shuffles orders once more:
    # only then can an order id that many baskets share, or lack, be split.
    by_order = (
        shop.orders.selectExpr("order_id", "hash(order_id) as spread", "order_status", f"{DELIVERY_DAYS} as days")
        .groupBy("order_id", "spread")
        .agg(
            *exprs(
                COPIES,
                "max(if(order_status = 'delivered', 1, 0)) as delivered",
                "sum(days) as days",
                "count(days) as deliveries",
            )
        )
    )
    sales = (
        baskets.join(by_order.drop("spread"), "order_id", "left")
        .groupBy("seller_id")
        .agg(
            *exprs(
                "count(order_id) as orders",
                "sum(delivered) as delivered_orders",
                "sum(days) as days",
                "sum(deliveries) as deliveries",
            ),
            *sum_totals("price", times="coalesce(copies, 1)"),
            *sum_totals("freight", times="coalesce(copies, 1)"),
        )
    )
    sellers = shop.sellers.groupBy("seller_id").agg(*exprs(COPIES))
    revenue = total("price", "freight", times="copies")
    return sellers.join(sales, "seller_id", "left").selectExpr(
        "seller_id",
        "coalesce(orders, 0) as orders",
        f"{revenue} as revenue",
        f"{total('freight', times='copies')} as freight_revenue",
        f"try_divide({revenue}, orders) as avg_order_value",
        "try_divide(days, deliveries) as avg_delivery_days",
        "coalesce(delivered_orders, 0) as delivered_orders",
    )


def customer_analytics(shop: Shop) -> DataFrame:
    """Spending of every customer, with or without orders."""
    # An order id may be shared by any number of customers, so this join must be
    # splittable; in the other marts few rows per order reach it.
    sales = (
        shop.orders.selectExpr("order_id", "customer_id", f"{zoneless('order_purchase_timestamp')} as purchase")
        .groupBy("order_id", "customer_id")
        .agg(*exprs(COPIES, "min(purchase) as first_order", "max(purchase) as last_order"))
        .join(_totals(shop, splittable=True), "order_id", "left")
        .groupBy("customer_id")
        .agg(
            *exprs(
                "count(order_id) as orders",
                "min(first_order) as first_order",
                "max(last_order) as last_order",
            ),
            *sum_totals("revenue", times="copies"),
        )
    )
    attributes = [
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    ]
    customers = shop.customers.groupBy(attributes).agg(*exprs(COPIES))
    spent = total("revenue", times="copies")
    return customers.join(sales, "customer_id", "left").selectExpr(
        *attributes,
        "coalesce(orders, 0) as orders",
        f"{spent} as total_spent",
        f"try_divide({spent}, orders) as avg_order_value",
        "first_order",
        "last_order",
    )


def geography_analytics(shop: Shop) -> DataFrame:
    """Sales by customer state; the NULL state and states without orders are kept."""
    people = shop.customers.selectExpr("customer_id", "customer_state as state", "customer_unique_id")
    homes = people.groupBy("customer_id", "state").agg(*exprs(COPIES))
    # Both sides reach the first join straight from a shuffle, so adaptive
    # execution can split a customer that holds a large share of the orders.
    sales = (
        shop.orders.selectExpr("customer_id", "order_id", f"{DELIVERY_DAYS} as days")
        .join(homes, "customer_id")
        .groupBy("state", "order_id")
        .agg(
            *exprs(
                "sum(copies) as copies",
                "sum(days * copies) as days",
                "sum(if(days is not null, copies, 0)) as deliveries",
            )
        )
        .join(_totals(shop), "order_id", "left")
        .groupBy("state")
        .agg(
            *exprs("count(order_id) as orders", "sum(days) as days", "sum(deliveries) as deliveries"),
            *sum_totals("revenue", times="copies"),
        )
    )
    # Distinct on a second, dependent column as well, to be shuffled once more for
    # the join: only then can a customer id with very many rows be split.
    ordering = shop.orders.selectExpr("customer_id", "hash(customer_id) as spread").distinct()
    buyers = (
        people.join(ordering, "customer_id", "left_semi")
        .select("state", "customer_unique_id")
        .distinct()
        .groupBy("state")
        .agg(*exprs("count(customer_unique_id) as unique_customers"))
    )
    return (
        people.select("state")
        .distinct()
        .alias("d")
        .join(sales.alias("s"), exprs("d.state <=> s.state")[0], "left")
        .join(buyers.alias("b"), exprs("d.state <=> b.state")[0], "left")
        .selectExpr(
            "d.state",
            "coalesce(unique_customers, 0) as unique_customers",
            "coalesce(orders, 0) as orders",
            f"{total('revenue')} as revenue",
            "try_divide(days, deliveries) as avg_delivery_days",
        )
    )
