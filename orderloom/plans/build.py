"""The batch build: four business tables and six marts, written as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators.access import OrderAccess
from orderloom.operators.contracts import MARTS
from orderloom.operators.documents import OrderDocuments, by_customer_newest_first, order_documents
from orderloom.operators.facts import order_totals
from orderloom.operators.loads import clean_dates, keyed
from orderloom.operators.ranged import PLACE, RANGE, DuplicateKeyError, RangedTable, write_ranged, write_sorted
from orderloom.operators.staging import scratch as scratch_folder
from orderloom.plans import registry
from orderloom.sources.shop import Shop

BUSINESS_KEYS = {"customers": "customer_id", "sellers": "seller_id", "products": "product_id"}
ORDERS = "orders"
TABLES = (*BUSINESS_KEYS, ORDERS, *MARTS)
# Names in the folder of builds.
MANIFEST = "current"
VERSION = "build-"
# Where an order of a key, or of a status, lies among the documents.
BY_KEY, BY_STATUS = "orders_by_key", "orders_by_status"
# Tables written at the same time.
AT_ONCE = 4
# The load of products repeats one with several translations, so its key may repeat.
MAY_REPEAT = ("products",)
# Documents are long: a read of one should not read many others.
DOCUMENT_BLOCK = 64


def write_documents(shop: Shop, folder: str, files: int | None = None) -> int:
    """Write the order documents, a customer's orders side by side and newest first.

    The list of blocks then leads a read by customer to its files and pages. Files
    are ranges of customer, time and key together, so the orders of one very large
    customer spread over several files.
    """
    files = files or int(shop.orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    built = order_documents(shop, files=files)
    documents = built.documents.repartitionById(files, "file")
    documents = documents.sortWithinPartitions(*by_customer_newest_first("_id")).drop("file")
    return write_sorted(documents, f"{folder}/{ORDERS}", "customer_id", block_rows=DOCUMENT_BLOCK)


def write_order_indexes(spark: SparkSession, folder: str) -> None:
    """Write where each order lies, by key and by status and key; an order id that repeats raises."""
    places = RangedTable(spark, f"{folder}/{ORDERS}").placed().select(
        "_id",
        "order_status",
        F.col("_metadata.file_name").alias("at_file"),
        F.col(RANGE).alias("at_range"),
        F.col(PLACE).alias("at_place"),
    )
    write_ranged(places, f"{folder}/{BY_KEY}", "_id", unique=True)
    write_ranged(places, f"{folder}/{BY_STATUS}", "_id", "order_status")


def read_documents(spark: SparkSession, folder: str) -> OrderDocuments:
    return OrderDocuments(read_table(spark, folder, ORDERS))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the build that ``folder`` has published."""
    if name not in TABLES:
        raise KeyError(f"unknown table: {name}")
    return ranged_table(spark, folder, name).rows()


def ranged_table(spark: SparkSession, folder: str, name: str) -> RangedTable:
    """A table of the published build with its blocks, for bounded reads."""
    return RangedTable(spark, f"{_published(spark, folder)}/{name}")


def order_access(spark: SparkSession, folder: str) -> OrderAccess:
    """Bounded reads of the published orders."""
    return OrderAccess(*[ranged_table(spark, folder, name) for name in (ORDERS, BY_KEY, BY_STATUS)])


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, folder: str) -> str | None:
    """Name of the build that the folder's manifest points to."""
    path, files = _path(spark, f"{folder}/{MANIFEST}")
    return spark.read.text(path.toString()).first()["value"] if files.exists(path) else None


def _published(spark: SparkSession, folder: str) -> str:
    version = published(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no complete build in {folder}")
    return f"{folder}/{version}"


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Point the manifest to a build, in one step; of the builds before, the last one stays for its readers."""
    before = published(spark, folder)
    draft, files = _path(spark, f"{folder}/{MANIFEST}-{version}")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = getattr(hadoop, "Options$Rename")
    overwrite = spark._sc._gateway.new_array(how, 1)
    overwrite[0] = how.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, _path(spark, f"{folder}/{MANIFEST}")[0], overwrite)
    for status in files.listStatus(_path(spark, folder)[0]):
        if status.getPath().getName().startswith(VERSION) and status.getPath().getName() not in (version, before):
            files.delete(status.getPath(), True)


def with_written_totals(shop: Shop, path: str) -> Shop:
    """Order totals written once to ``path``; three marts read them from there.

    As a table they reach each join straight from a shuffle, which lets adaptive
    execution split an order id that holds a large share of the orders.
    """
    order_totals(shop.order_items).write.parquet(path)
    return shop.with_order_totals(shop.orders.sparkSession.read.parquet(path))


def _side_by_side(ways: dict[str, Callable[[str], int]]) -> dict[str, int]:
    """Each name's function of it, a few at a time: one table's last tasks leave room for the next one's first."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        # The longest first.
        started = {name: pool.submit(ways[name], name) for name in sorted(ways, key=lambda n: n != ORDERS)}
        wait(started.values(), return_when=FIRST_EXCEPTION)
        failed = [f for f in started.values() if f.done() and f.exception()]
        if failed:
            pool.shutdown(wait=True, cancel_futures=True)
            raise failed[0].exception()
        return {name: started[name].result() for name in ways}


def build_all(shop: Shop, folder: str) -> dict[str, int]:
    """Write all ten tables and the order indexes and publish them together; returns the tables' row counts.

    Every table is written in the order of its key, and its key is checked while the
    list of its blocks is made: one that repeats raises, except in products. The tables
    go to a folder of their own, and readers follow the manifest, so a build that fails
    leaves the one before in place.
    """
    spark = shop.orders.sparkSession
    version = f"{VERSION}{uuid.uuid4().hex}"
    target, scratch = f"{folder}/{version}", scratch_folder(spark, "order-totals")
    try:
        # Before the others: three marts start from it, and its rows are shared by all of them.
        staged = with_written_totals(shop, scratch)

        def entity(name: str) -> int:
            table = clean_dates(keyed(registry.run(name, shop), BUSINESS_KEYS[name]))
            return write_ranged(table, f"{target}/{name}", unique=name not in MAY_REPEAT)

        def orders(name: str) -> int:
            rows = write_documents(shop, target)
            write_order_indexes(spark, target)
            return rows

        def mart(name: str) -> int:
            table = clean_dates(keyed(registry.run(name, staged), MARTS[name].key))
            return write_ranged(table, f"{target}/{name}", unique=True)

        ways = dict.fromkeys(BUSINESS_KEYS, entity) | {ORDERS: orders} | dict.fromkeys(MARTS, mart)
        counts = _side_by_side(ways)
        publish(spark, folder, version)
    except BaseException:
        path, files = _path(spark, target)
        files.delete(path, True)
        raise
    finally:
        path, files = _path(spark, scratch)
        files.delete(path, True)
    return counts


def is_built(spark: SparkSession, folder: str) -> bool:
    """A build was published, and it has orders."""
    return published(spark, folder) is not None and not read_table(spark, folder, ORDERS).isEmpty()


def build_once(shop: Shop, folder: str) -> dict[str, int] | None:
    """Build unless ``folder`` already holds a complete build; None when it does."""
    return None if is_built(shop.orders.sparkSession, folder) else build_all(shop, folder)
