"""Binding of TPC-H-like Parquet tables to the eight role tables.

The rules follow ``FIXTURES.md``: zero-padded zips, NULL states, categories and
freights, untranslated and doubly translated categories, unsold products, items
of unknown orders and products, orders of unknown customers, payments of unknown
orders, orders with several payments and reviews. Every row of the tables is
used: edge cases come from other keys, not from rows left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.shop import Shop

# Fixed values of the fixture: category name and its English name.
TRANSLATION_ROWS = [
    ("economy", "budget"),
    ("large", "big"),
    ("large", "very_big"),
    ("medium", "mid"),
    ("small", "small"),
]


# Columns and types of the Parquet tables. Reading with a schema
# saves the job that would look them up in the file footers.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        "c_custkey as customer_id",
        "c_custkey - c_custkey % 2 as customer_unique_id",
        "lpad(cast(c_nationkey as string), 5, '0') as customer_zip_code_prefix",
        "c_mktsegment as customer_city",
        "if(c_nationkey = 0, null, n_name) as customer_state",
    )


def sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, F.expr("s_nationkey = n_nationkey"), "left").selectExpr(
        "s_suppkey as seller_id",
        "lpad(cast(s_nationkey as string), 5, '0') as seller_zip_code_prefix",
        "s_name as seller_city",
        "n_name as seller_state",
    )


def products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey as product_id",
        "if(p_type = 'PROMO', null, lower(p_type)) as product_category_name",
        "cast(length(p_name) as bigint) as product_name_lenght",
        "cast(length(p_brand) as bigint) as product_description_lenght",
        "cast(p_size % 7 as bigint) as product_photos_qty",
        "cast(p_size * 10 as bigint) as product_weight_g",
        "cast(p_size as bigint) as product_length_cm",
        "cast(p_size + 1 as bigint) as product_height_cm",
        "cast(p_size + 2 as bigint) as product_width_cm",
    )


def translations(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', '{english}')" for name, english in TRANSLATION_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(product_category_name, product_category_name_english)")


def orders(order_table: DataFrame, lineitem: DataFrame) -> DataFrame:
    shipping = lineitem.groupBy("l_orderkey").agg(
        F.expr("min(l_shipdate) as first_ship"), F.expr("max(l_shipdate) as last_ship")
    )
    return order_table.join(shipping, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "o_orderkey as order_id",
        "if(o_custkey % 10 = 0, -o_custkey, o_custkey) as customer_id",
        "case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'canceled' end as order_status",
        "o_orderdate + interval 23 hour as order_purchase_timestamp",
        "if(o_orderkey % 100 = 0, null, o_orderdate + interval 24 hour) as order_approved_at",
        "first_ship as order_delivered_carrier_date",
        "if(o_orderstatus = 'F', last_ship, null) as order_delivered_customer_date",
        "o_orderdate + interval 30 day as order_estimated_delivery_date",
    )


def items(lineitem: DataFrame) -> DataFrame:
    # Whole cents and whole percents are exact in doubles, and so is their product.
    freight = "rint(l_extendedprice * 100) * rint(l_tax * 100) / 10000"
    return lineitem.selectExpr(
        "if(l_orderkey % 13 = 0, -l_orderkey, l_orderkey) as order_id",
        "cast(l_linenumber as bigint) as order_item_id",
        "if(l_partkey % 50 = 0, -l_partkey, l_partkey) as product_id",
        "if(l_suppkey % 25 = 0, l_suppkey - 1, l_suppkey) as seller_id",
        "l_shipdate as shipping_limit_date",
        "l_extendedprice as price",
        f"if(l_tax = 0, null, {freight}) as freight_value",
    )


def payments(order_table: DataFrame) -> DataFrame:
    first = order_table.selectExpr(
        "if(o_orderkey % 7 = 0, -o_orderkey, o_orderkey) as order_id",
        "1L as payment_sequential",
        "lower(o_orderpriority) as payment_type",
        "1 + o_orderkey % 10 as payment_installments",
        "o_totalprice as payment_value",
    )
    voucher = order_table.where("o_orderkey % 5 = 0").selectExpr(
        "o_orderkey as order_id",
        "2L as payment_sequential",
        "'voucher' as payment_type",
        "1L as payment_installments",
        "10.5D as payment_value",
    )
    return first.union(voucher)


def reviews(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as review_id",
        "user_id as order_id",
        "1 + event_id % 5 as review_score",
        "if(event_type = 'error', null, event_type) as review_comment_title",
        "ts as review_creation_date",
        "ts + interval 1 day as review_answer_timestamp",
    )


def bind(spark: SparkSession, folder: str) -> Shop:
    """Role tables over the Parquet files in ``folder``."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    return Shop(
        customers=lambda: customers(table("customer"), table("nation")),
        sellers=lambda: sellers(table("supplier"), table("nation")),
        products=lambda: products(table("part")),
        category_translation=lambda: translations(spark),
        orders=lambda: orders(table("orders"), table("lineitem")),
        order_items=lambda: items(table("lineitem")),
        order_payments=lambda: payments(table("orders")),
        order_reviews=lambda: reviews(table("events")),
    )
