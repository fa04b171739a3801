"""The eight datasets: their files, columns, keys, relations and date rules.

Fixed values: column names (including the spelling ``lenght``), column types and
file name endings are those of the published CSV files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CUSTOMERS = "customers"
SELLERS = "sellers"
PRODUCTS = "products"
TRANSLATIONS = "category_translation"
ORDERS = "orders"
ITEMS = "order_items"
PAYMENTS = "order_payments"
REVIEWS = "order_reviews"


TEXT = T.StringType()
WHOLE = T.LongType()
AMOUNT = T.DoubleType()
MOMENT = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


@dataclass(frozen=True)
class Dataset:
    name: str
    file_pattern: str
    schema: T.StructType
    # Free text may hold line breaks inside quotes.
    multiline: bool = False

    @property
    def text_schema(self) -> T.StructType:
        """Every column as text, for profiling values as they stand in the file."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.schema.names])


DATASETS: dict[str, Dataset] = {
    d.name: d
    for d in [
        Dataset(
            CUSTOMERS,
            "*customers_dataset.csv",
            _schema(
                customer_id=TEXT,
                customer_unique_id=TEXT,
                customer_zip_code_prefix=TEXT,
                customer_city=TEXT,
                customer_state=TEXT,
            ),
        ),
        Dataset(
            SELLERS,
            "*sellers_dataset.csv",
            _schema(
                seller_id=TEXT,
                seller_zip_code_prefix=TEXT,
                seller_city=TEXT,
                seller_state=TEXT,
            ),
        ),
        Dataset(
            PRODUCTS,
            "*products_dataset.csv",
            _schema(
                product_id=TEXT,
                product_category_name=TEXT,
                product_name_lenght=WHOLE,
                product_description_lenght=WHOLE,
                product_photos_qty=WHOLE,
                product_weight_g=WHOLE,
                product_length_cm=WHOLE,
                product_height_cm=WHOLE,
                product_width_cm=WHOLE,
            ),
        ),
        Dataset(
            TRANSLATIONS,
            "*category_name_translation.csv",
            _schema(
                product_category_name=TEXT,
                product_category_name_english=TEXT,
            ),
        ),
        Dataset(
            ORDERS,
            "*orders_dataset.csv",
            _schema(
                order_id=TEXT,
                customer_id=TEXT,
                order_status=TEXT,
                order_purchase_timestamp=MOMENT,
                order_approved_at=MOMENT,
                order_delivered_carrier_date=MOMENT,
                order_delivered_customer_date=MOMENT,
                order_estimated_delivery_date=MOMENT,
            ),
        ),
        Dataset(
            ITEMS,
            "*order_items_dataset.csv",
            _schema(
                order_id=TEXT,
                order_item_id=WHOLE,
                product_id=TEXT,
                seller_id=TEXT,
                shipping_limit_date=MOMENT,
                price=AMOUNT,
                freight_value=AMOUNT,
            ),
        ),
        Dataset(
            PAYMENTS,
            "*order_payments_dataset.csv",
            _schema(
                order_id=TEXT,
                payment_sequential=WHOLE,
                payment_type=TEXT,
                payment_installments=WHOLE,
                payment_value=AMOUNT,
            ),
        ),
        Dataset(
            REVIEWS,
            "*order_reviews_dataset.csv",
            _schema(
                review_id=TEXT,
                order_id=TEXT,
                review_score=WHOLE,
                review_comment_title=TEXT,
                review_comment_message=TEXT,
                review_creation_date=MOMENT,
                review_answer_timestamp=MOMENT,
            ),
            multiline=True,
        ),
    ]
}

# Columns that should identify a row, by dataset.
KEYS: dict[str, tuple[str, ...]] = {
    CUSTOMERS: ("customer_id",),
    SELLERS: ("seller_id",),
    PRODUCTS: ("product_id",),
    ORDERS: ("order_id",),
    ITEMS: ("order_id", "order_item_id"),
    PAYMENTS: ("order_id", "payment_sequential"),
}


@dataclass(frozen=True)
class Relation:
    """Every ``child.key`` should exist as ``parent.key``."""

    child: str
    parent: str
    key: str

    @property
    def label(self) -> str:
        return f"{self.child} without {self.parent}"


RELATIONS: tuple[Relation, ...] = (
    Relation(ORDERS, CUSTOMERS, "customer_id"),
    Relation(ITEMS, ORDERS, "order_id"),
    Relation(ITEMS, PRODUCTS, "product_id"),
    Relation(ITEMS, SELLERS, "seller_id"),
    Relation(PAYMENTS, ORDERS, "order_id"),
    Relation(REVIEWS, ORDERS, "order_id"),
)


@dataclass(frozen=True)
class DateRule:
    """``later`` should not lie before ``earlier`` (columns of the orders dataset)."""

    label: str
    later: str
    earlier: str


DATE_RULES: tuple[DateRule, ...] = (
    DateRule("approved before purchase", "order_approved_at", "order_purchase_timestamp"),
    DateRule("carrier before purchase", "order_delivered_carrier_date", "order_purchase_timestamp"),
    DateRule("delivered before purchase", "order_delivered_customer_date", "order_purchase_timestamp"),
    DateRule("delivered before carrier", "order_delivered_customer_date", "order_delivered_carrier_date"),
    DateRule("estimated before purchase", "order_estimated_delivery_date", "order_purchase_timestamp"),
)
