"""A small shop that breaks every rule, and the marts computed over it in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

from pyspark.sql import SparkSession

from orderloom.sources.catalog import DATASETS
from orderloom.sources.shop import Shop

START = datetime(2018, 1, 1)


def rows(seed: int = 7) -> dict[str, list[dict]]:
    """Repeated, missing and unknown keys in every table; one order, customer,
    product and seller hold about a third of the rows."""
    r = random.Random(seed)

    def key(prefix: str, n: int, null: float = 0.05) -> str | None:
        if r.random() < null:
            return None
        return f"{prefix}0" if r.random() < 0.33 else f"{prefix}{r.randrange(n)}"

    def time(null: float = 0.1) -> datetime | None:
        return None if r.random() < null else START + timedelta(minutes=r.randrange(60 * 24 * 120))

    def amount() -> float | None:
        return None if r.random() < 0.1 else r.randrange(1, 10**6) / 100

    def pick(*values):
        return r.choice(values)

    customers = [
        dict(
            customer_id=key("c", 25),
            customer_unique_id=f"u{r.randrange(12)}",
            customer_zip_code_prefix=f"{r.randrange(100):05d}",
            customer_city="city",
            customer_state=pick("SP", "RJ", "MG", None),
        )
        for _ in range(30)
    ]
    customers.append(customers[3] | {})
    customers.append(dict(customer_id="c999", customer_unique_id="u999", customer_zip_code_prefix="1",
                          customer_city="city", customer_state="XX"))
    sellers = [
        dict(seller_id=key("s", 8), seller_zip_code_prefix="01037", seller_city="city", seller_state="SP")
        for _ in range(10)
    ]
    numbers = [c for c in DATASETS["products"].schema.names if c not in ("product_id", "product_category_name")]
    products = [
        dict(product_id=key("p", 12), product_category_name=pick("a", "b", "c", "y", None)) | dict.fromkeys(numbers, 1)
        for _ in range(20)
    ]
    translations = [
        dict(product_category_name=n, product_category_name_english=e)
        for n, e in [("a", "x"), ("a", "w"), ("b", "y"), (None, "none"), ("c", None)]
    ]
    orders = [
        dict(
            order_id=key("o", 60),
            customer_id=key("c", 28),
            order_status=pick("delivered", "canceled", "shipped", None),
            order_purchase_timestamp=time(),
            order_approved_at=time(),
            order_delivered_carrier_date=time(),
            order_delivered_customer_date=time(0.3),
            order_estimated_delivery_date=time(),
        )
        for _ in range(120)
    ]
    items = [
        dict(
            order_id=key("o", 70),
            order_item_id=r.randrange(1, 4),
            product_id=key("p", 14),
            seller_id=key("s", 10),
            shipping_limit_date=time(),
            price=amount(),
            freight_value=amount(),
        )
        for _ in range(300)
    ]
    payments = [
        dict(
            order_id=key("o", 70),
            payment_sequential=r.randrange(1, 3),
            payment_type=pick("card", "voucher", None),
            payment_installments=r.randrange(1, 5),
            payment_value=amount(),
        )
        for _ in range(150)
    ]
    reviews = [
        dict(
            review_id=f"r{i}",
            order_id=key("o", 70),
            review_score=pick(1, 2, 3, 4, 5, None),
            review_comment_title=pick("t", " ", None),
            review_comment_message=pick("two\nlines", "", None),
            review_creation_date=time(),
            review_answer_timestamp=time(),
        )
        for i in range(120)
    ]
    return dict(
        customers=customers,
        sellers=sellers,
        products=products,
        category_translation=translations,
        orders=orders,
        order_items=items,
        order_payments=payments,
        order_reviews=reviews,
    )


def shop(spark: SparkSession, tables: dict[str, list[dict]]) -> Shop:
    frames = {}
    for name, dataset in DATASETS.items():
        values = [tuple(row[c] for c in dataset.schema.names) for row in tables[name]]
        frames[name] = spark.createDataFrame(values, dataset.schema)
    return Shop(**frames)


def exact(value: float | None) -> Fraction:
    return Fraction(0) if value is None else Fraction(round(value * 10_000), 10_000)


def mean(values: list) -> float | None:
    known = [v for v in values if v is not None]
    return float(sum(known, Fraction(0)) / len(known)) if known else None


def days(order: dict) -> int | None:
    start, end = order["order_purchase_timestamp"], order["order_delivered_customer_date"]
    return None if start is None or end is None else (end.date() - start.date()).days


def distinct(values) -> int:
    return len({v for v in values if v is not None})


def line(item: dict) -> Fraction:
    return exact(item["price"]) + exact(item["freight_value"])


def _grouped(table: list[dict], *keys: str) -> dict[tuple, list[dict]]:
    groups = defaultdict(list)
    for row in table:
        groups[tuple(row[k] for k in keys)].append(row)
    return groups


def _matching(groups: dict[tuple, list[dict]], *values) -> list[dict]:
    return [] if any(v is None for v in values) else groups.get(tuple(values), [])


def _english(tables) -> dict[str, str | None]:
    names = {}
    for (category,), found in _grouped(tables["category_translation"], "product_category_name").items():
        if category is not None:
            names[category] = min(
                (t["product_category_name_english"] for t in found if t["product_category_name_english"] is not None),
                default=None,
            )
    return names


def monthly_metrics(tables) -> dict:
    items = _grouped(tables["order_items"], "order_id")
    reviews = _grouped(tables["order_reviews"], "order_id")

    def month(o):
        t = o["order_purchase_timestamp"]
        return None if t is None else t.replace(day=1, hour=0, minute=0)

    result = {}
    for m in {month(o) for o in tables["orders"]}:
        orders = [o for o in tables["orders"] if month(o) == m]
        lines = [i for o in orders for i in _matching(items, o["order_id"])]
        ids = distinct(o["order_id"] for o in orders)
        revenue = sum(map(line, lines), Fraction(0))
        scores = []
        for o in orders:
            given = [r["review_score"] for r in _matching(reviews, o["order_id"]) if r["review_score"] is not None]
            scores.append(Fraction(sum(given), len(given)) if given else None)
        result[m] = dict(
            orders=ids,
            delivered_orders=distinct(o["order_id"] for o in orders if o["order_status"] == "delivered"),
            cancelled_orders=distinct(o["order_id"] for o in orders if o["order_status"] == "canceled"),
            revenue=float(revenue),
            freight=float(sum((exact(i["freight_value"]) for i in lines), Fraction(0))),
            avg_order_value=float(revenue / ids) if ids else None,
            avg_delivery_days=mean([days(o) for o in orders]),
            avg_review_score=mean(scores),
        )
    return result


def product_analytics(tables) -> dict:
    items = _grouped(tables["order_items"], "product_id")
    english = _english(tables)
    result = {}
    for (product, category), copies in _grouped(tables["products"], "product_id", "product_category_name").items():
        lines = _matching(items, product)
        sold = [i for i in lines if i["order_id"] is not None]
        n = len(copies)
        result[product, category] = dict(
            product_category_name_english=english.get(category),
            total_orders=distinct(i["order_id"] for i in lines),
            units_sold=n * len(lines),
            revenue=float(n * sum(map(line, lines), Fraction(0))),
            freight_revenue=float(n * sum((exact(i["freight_value"]) for i in lines), Fraction(0))),
            avg_price=float(sum((exact(i["price"]) for i in lines), Fraction(0)) / len(lines)) if sold else None,
            unique_sellers=distinct(i["seller_id"] for i in lines),
        )
    return result


def category_analytics(tables) -> dict:
    items = _grouped(tables["order_items"], "product_id")
    english = _english(tables)

    def names(p):
        e = english.get(p["product_category_name"])
        return (e or p["product_category_name"] or "uncategorized", e)

    result = {}
    for key in {names(p) for p in tables["products"]}:
        lines = [i for p in tables["products"] if names(p) == key for i in _matching(items, p["product_id"])]
        sold = [i for i in lines if i["order_id"] is not None]
        result[key] = dict(
            orders=distinct(i["order_id"] for i in lines),
            units_sold=len(lines),
            revenue=float(sum(map(line, lines), Fraction(0))),
            freight_revenue=float(sum((exact(i["freight_value"]) for i in lines), Fraction(0))),
            avg_price=float(sum((exact(i["price"]) for i in lines), Fraction(0)) / len(lines)) if sold else None,
        )
    return result


def seller_analytics(tables) -> dict:
    items = _grouped(tables["order_items"], "seller_id")
    orders = _grouped(tables["orders"], "order_id")
    result = {}
    for (seller,), copies in _grouped(tables["sellers"], "seller_id").items():
        n = len(copies)
        revenue = freight = Fraction(0)
        taken, delivered = [], set()
        lines = _matching(items, seller)
        for (order_id,), basket in _grouped(lines, "order_id").items():
            found = _matching(orders, order_id)
            times = n * max(len(found), 1)
            revenue += times * sum(map(line, basket), Fraction(0))
            freight += times * sum((exact(i["freight_value"]) for i in basket), Fraction(0))
            taken += [days(o) for o in found]
            if any(o["order_status"] == "delivered" for o in found):
                delivered.add(order_id)
        ids = distinct(i["order_id"] for i in lines)
        result[seller] = dict(
            orders=ids,
            revenue=float(revenue),
            freight_revenue=float(freight),
            avg_order_value=float(revenue / ids) if ids else None,
            avg_delivery_days=mean(taken),
            delivered_orders=len(delivered),
        )
    return result


ATTRIBUTES = (
    "customer_id",
    "customer_unique_id",
    "customer_zip_code_prefix",
    "customer_city",
    "customer_state",
)


def customer_analytics(tables) -> dict:
    items = _grouped(tables["order_items"], "order_id")
    orders = _grouped(tables["orders"], "customer_id")
    result = {}
    for key, copies in _grouped(tables["customers"], *ATTRIBUTES).items():
        own = _matching(orders, key[0])
        spent = len(copies) * sum(
            (line(i) for o in own for i in _matching(items, o["order_id"])), Fraction(0)
        )
        ids = distinct(o["order_id"] for o in own)
        times = [o["order_purchase_timestamp"] for o in own if o["order_purchase_timestamp"] is not None]
        result[key] = dict(
            orders=ids,
            total_spent=float(spent),
            avg_order_value=float(spent / ids) if ids else None,
            first_order=min(times, default=None),
            last_order=max(times, default=None),
        )
    return result


def geography_analytics(tables) -> dict:
    items = _grouped(tables["order_items"], "order_id")
    orders = _grouped(tables["orders"], "customer_id")
    result = {}
    for (state,), people in _grouped(tables["customers"], "customer_state").items():
        pairs = [(c, o) for c in people for o in _matching(orders, c["customer_id"])]
        lines = [i for _, o in pairs for i in _matching(items, o["order_id"])]
        result[state] = dict(
            unique_customers=distinct(c["customer_unique_id"] for c, _ in pairs),
            orders=distinct(o["order_id"] for _, o in pairs),
            revenue=float(sum(map(line, lines), Fraction(0))),
            avg_delivery_days=mean([days(o) for _, o in pairs]),
        )
    return result


KEYS = {
    "monthly_metrics": ("month",),
    "product_analytics": ("product_id", "product_category_name"),
    "category_analytics": ("category", "category_english"),
    "seller_analytics": ("seller_id",),
    "customer_analytics": ATTRIBUTES,
    "geography_analytics": ("state",),
}

EXPECTED = {
    "monthly_metrics": monthly_metrics,
    "product_analytics": product_analytics,
    "category_analytics": category_analytics,
    "seller_analytics": seller_analytics,
    "customer_analytics": customer_analytics,
    "geography_analytics": geography_analytics,
}
