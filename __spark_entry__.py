"""Entry points: a flagship query, the registered queries, and SQL to check them against."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks import oracle  # noqa: E402
from orderloom.operators import contracts, loads, quality, serving  # noqa: E402
from orderloom.operators.documents import order_documents, typed_orders, typed_reviews  # noqa: E402
from orderloom.operators.access import OrderAccess, first_of_built_mart  # noqa: E402
from orderloom.operators.ranged import RangedTable, write_ranged  # noqa: E402
from orderloom.operators.staging import scratch  # noqa: E402
from orderloom.plans import aggregates, build, registry  # noqa: E402
from orderloom.sources import reader  # noqa: E402
from orderloom.sources.bindings import bind  # noqa: E402
from orderloom.sources.shop import Shop  # noqa: E402

try:
    from orderloom.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in ("orderloom.llm", "corpus_pipeline"):  # only these may be left out
        raise
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the bounded reads.
PAGE_SIZE = 20
DEEP_PAGE = 401
SHALLOW = 1_000
AFTER = 5_000
ONE_ORDER = 10
ONE_CUSTOMER = 85

# Text in one part file of a split table, and the least number of its files.
FILE_BYTES = 32 * 2**20
LEAST_FILES = 16


def entry(spark: SparkSession) -> DataFrame:
    """Monthly metrics on the smallest test data."""
    return queries()["monthly_metrics"](spark, "/root/testdata/sf0.001")


def _on_shop(build: Callable[[Shop], DataFrame]) -> Query:
    return lambda spark, folder: build(bind(spark, folder))


def _mart(name: str) -> Callable[[Shop], DataFrame]:
    return lambda shop: registry.run(name, shop)


def _top_n(name: str) -> Query:
    return _on_shop(lambda shop: serving.first_of_mart(_mart(name)(shop), name, serving.MAX_SIZE))


def _keyed_orders(shop: Shop) -> DataFrame:
    return loads.keyed(typed_orders(shop.orders), "order_id")


def _numbered(page: DataFrame, *order: Column | str) -> DataFrame:
    """Position of each row of a page; a page is bounded."""
    return page.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def _page_offset(shop: Shop) -> DataFrame:
    return _numbered(serving.orders_page(_keyed_orders(shop), 3, PAGE_SIZE, "delivered").items, "_id")


def _page_deep(shop: Shop) -> DataFrame:
    skip = (DEEP_PAGE - 1) * PAGE_SIZE
    return _numbered(serving.offset_rows(_keyed_orders(shop), "_id", skip, PAGE_SIZE, SHALLOW, 64), "_id")


def _page_keyset(shop: Shop) -> DataFrame:
    return _numbered(serving.page_after(_keyed_orders(shop), "_id", AFTER, PAGE_SIZE), "_id")


def _of_customer(shop: Shop) -> DataFrame:
    page = serving.orders_of_customer(_keyed_orders(shop), ONE_CUSTOMER, PAGE_SIZE)
    return _numbered(page, F.desc("order_purchase_timestamp"), "_id")


def _access(shop: Shop) -> OrderAccess:
    """The order documents and their indexes, written as a build writes them."""
    spark = shop.orders.sparkSession
    folder = scratch(spark, "orders")
    build.write_documents(shop, folder)
    build.write_order_indexes(spark, folder)
    return OrderAccess(*[RangedTable(spark, f"{folder}/{name}") for name in (build.ORDERS, build.BY_KEY, build.BY_STATUS)])


def _built(read: Callable[[OrderAccess], DataFrame]) -> Query:
    """A page of written orders without their arrays, numbered by key."""
    return _on_shop(lambda shop: _numbered(read(_access(shop)).drop(*contracts.ORDER_ARRAYS), "_id"))


def _built_of_customer(shop: Shop) -> DataFrame:
    page = _access(shop).of_customer(ONE_CUSTOMER, PAGE_SIZE).drop(*contracts.ORDER_ARRAYS)
    return _numbered(page, F.desc("order_purchase_timestamp"), "_id")


def _built_envelope(shop: Shop) -> DataFrame:
    return _envelope(shop, _access(shop).page(2, PAGE_SIZE, "delivered"))


def _built_top_n(shop: Shop) -> DataFrame:
    """The first rows of a mart written in the order of its key."""
    name = "customer_analytics"
    spark = shop.orders.sparkSession
    folder = scratch(spark, name)
    write_ranged(loads.keyed(registry.run(name, shop), contracts.MARTS[name].key), folder, unique=True)
    return first_of_built_mart(RangedTable(spark, folder), name, serving.MAX_SIZE)


def _documents_flat(shop: Shop) -> DataFrame:
    def total(array: str, field: str) -> Column:
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e[field])

    none = F.lit(-1)
    return order_documents(shop).documents.select(
        "_id",
        "customer_id",
        "order_status",
        *[F.size(a).cast("bigint").alias(f"n_{a}") for a in ("items", "payments", "reviews")],
        total("items", "order_item_id").alias("item_ids"),
        total("payments", "payment_installments").alias("installments"),
        total("reviews", "review_score").alias("scores"),
        F.coalesce(F.try_element_at("items", F.lit(-1))["order_item_id"], none).alias("last_item"),
        F.try_element_at("payments", F.lit(1))["payment_type"].alias("first_payment"),
        F.coalesce(F.try_element_at("reviews", F.lit(-1))["review_id"], none).alias("last_review"),
    )


def _unwound(array: str) -> Query:
    return _on_shop(lambda shop: order_documents(shop).unwind(array))


def _dates_as_text(shop: Shop) -> DataFrame:
    """Reviews with one date column as text and one as a date."""
    return loads.clean_dates(
        shop.order_reviews.select(
            "review_id",
            "review_comment_title",
            F.col("review_creation_date").cast("string").alias("review_creation_date"),
            F.col("review_answer_timestamp").cast("date").alias("review_answer_timestamp"),
        )
    )


def _entity(name: str) -> Query:
    return _on_shop(lambda shop: contracts.conform(registry.run(name, shop), contracts.ENTITIES[name]))


def _orders_contract(shop: Shop) -> DataFrame:
    orders = contracts.conform_orders(order_documents(shop).documents)
    sizes = [F.size(a).cast("bigint").alias(a) for a in contracts.ORDER_ARRAYS]
    return orders.select(*contracts.ORDER_FIELDS, *sizes)


def _dirty_mart(shop: Shop) -> DataFrame:
    """Customer sales stored as text, some of it unreadable, by the key's last digit; normalised and as the contract has it."""
    contract = contracts.MARTS["customer_analytics"]
    stored = registry.run("customer_analytics", shop).selectExpr(
        "customer_id as _id",
        """case customer_id % 10 when 0 then concat(' ', orders, ' ') when 1 then concat(orders, '.5') when 2 then ''
             when 3 then 'many' when 4 then null else cast(orders as string) end as orders""",
        """case customer_id % 10 when 5 then 'nan' when 6 then 'Infinity' when 7 then concat('  ', total_spent)
             when 8 then 'abc' when 9 then null else cast(total_spent as string) end as total_spent""",
        "case customer_id % 10 when 7 then '1e999' when 8 then '2.5e1' else cast(avg_order_value as string) end as avg_order_value",
        """case customer_id % 10 when 5 then concat(date_format(first_order, "yyyyMMdd'T'HHmmss"), '+0200')
             when 6 then concat(date_format(first_order, 'yyyy-MM-dd HH:mm:ss'), '.123456789Z')
             when 7 then 'soon' else date_format(first_order, 'yyyy-MM-dd') end as first_order""",
    )
    kept = ["_id", "orders", "total_spent", "avg_order_value", "first_order"]
    return contracts.conform(contracts.normalize(stored, contract), contract).select(*kept)


def _landed_drift(shop: Shop) -> DataFrame:
    """What is found wrong with landed orders and items of which one column was renamed, one retyped, one added."""
    spark = shop.orders.sparkSession
    folder = scratch(spark, "landed")
    orders = reader.typed_like(shop.orders, "orders").withColumnRenamed("order_status", "status")
    items = reader.typed_like(shop.order_items, "order_items").withColumn("price", F.col("price").cast("string"))
    orders.write.parquet(f"{folder}/orders")
    items.write.parquet(f"{folder}/order_items")
    return reader.landed_drift(spark, folder, ["orders", "order_items"])


def _sorted_mart(shop: Shop) -> DataFrame:
    """A mart as it is shown, each row with the place it comes at; its rows are as few as there are states."""
    shown = registry.run_sorted("geography_analytics", shop).coalesce(1)
    return shown.withColumn("position", F.monotonically_increasing_id() + 1)


def _order_violations(shop: Shop) -> DataFrame:
    """Orders whose customer or status was taken away or changed, by the key's last digits."""
    spoiled = _keyed_orders(shop).selectExpr(
        "_id",
        "if(_id % 7 = 0, null, customer_id) as customer_id",
        "case _id % 11 when 0 then null when 1 then 'lost' else order_status end as order_status",
        "if(_id % 13 = 0, null, array()) as items",
        "array() as payments",
        "if(_id % 17 = 0, null, array()) as reviews",
    )
    return contracts.order_violations(spoiled)


def _page_envelope(shop: Shop) -> DataFrame:
    return _envelope(shop, serving.orders_page(_keyed_orders(shop), 2, PAGE_SIZE, "delivered"))


def _envelope(shop: Shop, page: serving.Page) -> DataFrame:
    row = (page.total, page.page, page.size, page.total_pages)
    return shop.orders.sparkSession.createDataFrame(
        [row], "total bigint, page bigint, size bigint, total_pages bigint"
    )


def _through_csv(table: DataFrame, name: str) -> DataFrame:
    """The table written as CSV part files to the shared folder and read back."""
    spark = table.sparkSession
    folder = scratch(spark, "csv")
    reader.write_csv(reader.typed_like(table, name), folder, name)
    return reader.read_csv(spark, folder, name)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, whole texts with quotes and line breaks, as reviews."""
    return spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "doc_id as review_id",
        "doc_id as order_id",
        "doc_id % 5 + 1 as review_score",
        "lang as review_comment_title",
        "text as review_comment_message",
    )


def _split(texts: DataFrame) -> DataFrame:
    """The texts dealt evenly to as many partitions as their bytes need."""
    size = texts.agg(F.sum(F.octet_length("review_comment_message"))).first()[0] or 0
    return texts.repartition(max(LEAST_FILES, -(-size // FILE_BYTES)))


def _texts_through_csv(dealt: Callable[[DataFrame], DataFrame]) -> Query:
    """The documents through CSV; one task writes, and one reads, each partition of ``dealt``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        kept = ["review_id", "review_score", "review_comment_title", "review_comment_message"]
        return _through_csv(dealt(_texts(spark, folder)), "order_reviews").select(kept)

    return run


def queries() -> dict[str, Query]:
    """One entry per operator; each takes the session and a folder of Parquet tables."""
    marts = {name: _on_shop(_mart(name)) for name in contracts.MARTS}
    top_n = {f"{name}_top_n": _top_n(name) for name in contracts.MARTS}
    others: dict[str, Callable[[Shop], DataFrame]] = {
        "category_analytics_normalized": lambda s: contracts.normalize(
            registry.run("category_analytics", s), contracts.MARTS["category_analytics"]
        ),
        "orders_by_status": lambda s: aggregates.orders_by_status(s.orders),
        "payments_by_type": lambda s: aggregates.payments_by_type(s.order_payments, s.orders),
        "payments_by_type_unwound": lambda s: aggregates.unwound_payments_by_type(
            order_documents(s).unwind("payments")
        ),
        "customers_load": lambda s: loads.keyed(s.customers, "customer_id"),
        "sellers_load": lambda s: loads.keyed(s.sellers, "seller_id"),
        "products_enriched": lambda s: registry.run("products", s),
        "orders_typed": lambda s: registry.run("orders", s),
        "order_items_load": lambda s: registry.run("order_items", s),
        "order_payments_load": lambda s: registry.run("order_payments", s),
        "order_reviews_typed": lambda s: typed_reviews(s.order_reviews),
        "review_dates_cleaned": _dates_as_text,
        "order_documents_flat": _documents_flat,
        "dq_row_counts": quality.row_counts,
        "dq_missing_values": quality.missing_values,
        "dq_duplicate_keys": quality.duplicate_keys,
        "dq_orphans": quality.orphans,
        "dq_findings": quality.findings,
        "geography_analytics_sorted": _sorted_mart,
        "dq_date_order": lambda s: quality.date_order(s.orders),
        "orders_page_offset": _page_offset,
        "orders_page_deep": _page_deep,
        "orders_page_keyset": _page_keyset,
        "orders_page_envelope": _page_envelope,
        "orders_contract": _orders_contract,
        "orders_from_csv": lambda s: _through_csv(s.orders, "orders"),
        "items_from_csv": lambda s: _through_csv(s.order_items, "order_items"),
        "order_by_id": lambda s: serving.by_key(_keyed_orders(s), ONE_ORDER),
        "orders_by_customer": _of_customer,
        "customer_analytics_dirty": _dirty_mart,
        "order_violations": _order_violations,
        "landed_drift": _landed_drift,
        "customers_violations": lambda s: contracts.entity_violations(s.customers, contracts.ENTITIES["customers"]).select(
            F.col("_id").cast("string").alias("_id"), "violation"
        ),
    }
    unwound = {f"order_{array}_unwound": _unwound(array) for array in ("items", "payments", "reviews")}
    entities = {f"{name}_contract": _entity(name) for name in contracts.ENTITIES}
    texts = {
        "texts_from_csv": _texts_through_csv(lambda texts: texts),
        "texts_from_csv_split": _texts_through_csv(_split),
    }
    built = {
        "orders_page_offset_built": _built(lambda a: a.page(3, PAGE_SIZE, "delivered").items),
        "orders_page_deep_built": _built(lambda a: a.page(DEEP_PAGE, PAGE_SIZE).items),
        "orders_page_keyset_built": _built(lambda a: a.after(AFTER, PAGE_SIZE)),
        "orders_by_customer_built": _on_shop(_built_of_customer),
        "order_by_id_built": _on_shop(lambda s: _access(s).by_id(ONE_ORDER).drop(*contracts.ORDER_ARRAYS)),
        "orders_page_envelope_built": _on_shop(_built_envelope),
        "customer_analytics_top_n_built": _on_shop(_built_top_n),
    }
    on_corpus = corpus.QUERIES if corpus else {}
    return marts | top_n | texts | built | {name: _on_shop(build) for name, build in others.items()} | unwound | entities | on_corpus


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query."""
    return oracle.oracle_sql(PAGE_SIZE, DEEP_PAGE, AFTER, ONE_ORDER, ONE_CUSTOMER) | (corpus.ORACLE if corpus else {})
