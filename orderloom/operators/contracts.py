"""Output contracts: what each served table looks like, and how it is brought there."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions import coerce


class Kind(Enum):
    """Role of a field: its type, its default, and how it is read leniently."""

    TEXT = "text"
    WHOLE = "whole"
    REAL = "real"
    COUNT = "count"
    MONEY = "money"
    RATIO = "ratio"
    MOMENT = "moment"


TYPES: dict[Kind, T.DataType] = {
    Kind.TEXT: T.StringType(),
    Kind.WHOLE: T.IntegerType(),
    Kind.REAL: T.DoubleType(),
    Kind.COUNT: T.LongType(),
    Kind.MONEY: T.DoubleType(),
    Kind.RATIO: T.DoubleType(),
    Kind.MOMENT: T.TimestampNTZType(),
}

DEFAULTS = {Kind.COUNT: 0, Kind.MONEY: 0.0}


@dataclass(frozen=True)
class Contract:
    """Fields in output order; the key is always served as ``_id``."""

    key: str
    fields: dict[str, Kind]
    # The count that decides whether a row had any sales.
    decider: str | None = None
    # Key of rows whose key is NULL.
    fallback_key: str | None = None
    required: tuple[str, ...] = field(default=())

    def names(self, *kinds: Kind) -> list[str]:
        return [name for name, kind in self.fields.items() if kind in kinds]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in self.fields.items()])


# Field names, types and defaults of the served tables.
MARTS: dict[str, Contract] = {
    "monthly_metrics": Contract(
        key="month",
        fields={
            "_id": Kind.MOMENT,
            "orders": Kind.COUNT,
            "delivered_orders": Kind.COUNT,
            "cancelled_orders": Kind.COUNT,
            "revenue": Kind.MONEY,
            "freight": Kind.MONEY,
            "avg_order_value": Kind.RATIO,
            "avg_delivery_days": Kind.RATIO,
            "avg_review_score": Kind.RATIO,
        },
        decider="orders",
    ),
    "product_analytics": Contract(
        key="product_id",
        fields={
            "_id": Kind.TEXT,
            "product_category_name": Kind.TEXT,
            "product_category_name_english": Kind.TEXT,
            "total_orders": Kind.COUNT,
            "units_sold": Kind.COUNT,
            "revenue": Kind.MONEY,
            "freight_revenue": Kind.MONEY,
            "avg_price": Kind.RATIO,
            "unique_sellers": Kind.COUNT,
        },
        decider="total_orders",
    ),
    "category_analytics": Contract(
        key="category",
        fields={
            "_id": Kind.TEXT,
            "category_english": Kind.TEXT,
            "orders": Kind.COUNT,
            "units_sold": Kind.COUNT,
            "revenue": Kind.MONEY,
            "freight_revenue": Kind.MONEY,
            "avg_price": Kind.RATIO,
        },
        decider="orders",
        fallback_key="uncategorized",
    ),
    "seller_analytics": Contract(
        key="seller_id",
        fields={
            "_id": Kind.TEXT,
            "orders": Kind.COUNT,
            "revenue": Kind.MONEY,
            "freight_revenue": Kind.MONEY,
            "avg_order_value": Kind.RATIO,
            "avg_delivery_days": Kind.RATIO,
            "delivered_orders": Kind.COUNT,
        },
        decider="orders",
    ),
    "customer_analytics": Contract(
        key="customer_id",
        fields={
            "_id": Kind.TEXT,
            "customer_unique_id": Kind.TEXT,
            "customer_zip_code_prefix": Kind.WHOLE,
            "customer_city": Kind.TEXT,
            "customer_state": Kind.TEXT,
            "orders": Kind.COUNT,
            "total_spent": Kind.MONEY,
            "avg_order_value": Kind.RATIO,
            "first_order": Kind.MOMENT,
            "last_order": Kind.MOMENT,
        },
        decider="orders",
    ),
    "geography_analytics": Contract(
        key="state",
        fields={
            "_id": Kind.TEXT,
            "unique_customers": Kind.COUNT,
            "orders": Kind.COUNT,
            "revenue": Kind.MONEY,
            "avg_delivery_days": Kind.RATIO,
        },
        decider="orders",
    ),
}

ENTITIES: dict[str, Contract] = {
    "customers": Contract(
        key="customer_id",
        fields={
            "_id": Kind.TEXT,
            "customer_unique_id": Kind.TEXT,
            "customer_zip_code_prefix": Kind.WHOLE,
            "customer_city": Kind.TEXT,
            "customer_state": Kind.TEXT,
        },
        required=("_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"),
    ),
    "sellers": Contract(
        key="seller_id",
        fields={
            "_id": Kind.TEXT,
            "seller_zip_code_prefix": Kind.WHOLE,
            "seller_city": Kind.TEXT,
            "seller_state": Kind.TEXT,
        },
        required=("_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    ),
    "products": Contract(
        key="product_id",
        fields={
            "_id": Kind.TEXT,
            "product_category_name": Kind.TEXT,
            "product_category_name_english": Kind.TEXT,
            "product_name_lenght": Kind.WHOLE,
            "product_description_lenght": Kind.WHOLE,
            "product_photos_qty": Kind.WHOLE,
            "product_weight_g": Kind.REAL,
            "product_length_cm": Kind.REAL,
            "product_height_cm": Kind.REAL,
            "product_width_cm": Kind.REAL,
        },
        required=("_id",),
    ),
}

# The order statuses.
ORDER_STATUSES = (
    "delivered",
    "shipped",
    "canceled",
    "invoiced",
    "processing",
    "created",
    "approved",
    "unavailable",
)

ORDER_FIELDS: dict[str, Kind] = {
    "_id": Kind.TEXT,
    "customer_id": Kind.TEXT,
    "order_status": Kind.TEXT,
    "order_purchase_timestamp": Kind.MOMENT,
    "order_approved_at": Kind.MOMENT,
    "order_delivered_carrier_date": Kind.MOMENT,
    "order_delivered_customer_date": Kind.MOMENT,
    "order_estimated_delivery_date": Kind.MOMENT,
}
ORDER_ARRAYS = ("items", "payments", "reviews")


def served(table: DataFrame, contract: Contract) -> DataFrame:
    """The table with its key named ``_id``."""
    return table if "_id" in table.columns else table.withColumnRenamed(contract.key, "_id")


def conform(table: DataFrame, contract: Contract) -> DataFrame:
    """Exactly the contract's fields and types; an absent field takes its default."""
    table = served(table, contract)

    def shaped(name: str, kind: Kind) -> Column:
        column = F.col(name) if name in table.columns else F.lit(DEFAULTS.get(kind))
        return column.cast(TYPES[kind]).alias(name)

    return table.select(*[shaped(name, kind) for name, kind in contract.fields.items()])


def normalize(table: DataFrame, contract: Contract) -> DataFrame:
    """Lenient reading of a stored mart, in one projection.

    Counts and money become 0 when unreadable, ratios and moments NULL. A row
    whose deciding count is 0 has all counts and money 0 and all ratios NULL.
    Columns outside the contract stay; contract fields that are absent are added.
    """
    table = served(table, contract)
    kinds = {f.name: f.dataType for f in table.schema.fields}

    def read(name: str, reader) -> Column:
        if name not in kinds:
            return reader(F.lit(None), T.NullType())
        return reader(F.col(f"`{name}`"), kinds[name])

    no_sales = read(contract.decider, coerce.as_count) == 0
    columns: dict[str, Column] = {}
    if contract.fallback_key is not None and "_id" in kinds:
        columns["_id"] = F.coalesce("_id", F.lit(contract.fallback_key))
    for name in contract.names(Kind.COUNT):
        columns[name] = F.when(no_sales, F.lit(0).cast("bigint")).otherwise(read(name, coerce.as_count))
    for name in contract.names(Kind.MONEY):
        columns[name] = F.when(no_sales, F.lit(0.0)).otherwise(read(name, coerce.as_money))
    for name in contract.names(Kind.RATIO):
        columns[name] = F.when(~no_sales, read(name, coerce.as_float))
    for name in contract.names(Kind.MOMENT):
        if name != "_id":
            columns[name] = read(name, coerce.as_moment)
    return table.withColumns(columns)


def conform_orders(documents: DataFrame) -> DataFrame:
    """Order documents with contract types; arrays keep their element fields."""
    fields = [F.col(name).cast(TYPES[kind]).alias(name) for name, kind in ORDER_FIELDS.items()]
    return documents.select(*fields, *ORDER_ARRAYS)


def order_violations(documents: DataFrame) -> DataFrame:
    """``(_id, violation)`` for every order that breaks its contract."""
    checks = {
        "missing id": F.col("_id").isNull(),
        "missing customer": F.col("customer_id").isNull(),
        "unknown status": F.col("order_status").isNull() | ~F.col("order_status").isin(*ORDER_STATUSES),
    } | {f"missing {array}": F.col(array).isNull() for array in ORDER_ARRAYS}
    return _violations(documents, checks)


def entity_violations(table: DataFrame, contract: Contract) -> DataFrame:
    """``(_id, violation)`` for every required field that is NULL or does not fit its type."""
    table = served(table, contract)

    def broken(name: str) -> Column:
        if name not in table.columns:
            return F.lit(True)
        return F.col(name).cast("string").try_cast(TYPES[contract.fields[name]]).isNull()

    return _violations(table, {f"missing {name}": broken(name) for name in contract.required})


def _violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(condition, label) for label, condition in checks.items()]))
    return table.select("_id", F.explode(found).alias("violation"))
