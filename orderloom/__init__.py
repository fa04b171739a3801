"""Analytics over e-commerce orders as PySpark DataFrame operations."""

from orderloom.operators.contracts import ENTITIES, MARTS
from orderloom.operators.documents import OrderDocuments, order_documents
from orderloom.plans.build import build_all, build_once
from orderloom.plans.registry import QUERIES, run
from orderloom.plans.report import quality_report
from orderloom.session import builder
from orderloom.sources.bindings import bind
from orderloom.sources.reader import land_parquet, read_shop_csv, read_shop_parquet
from orderloom.sources.shop import Shop

__all__ = [
    "ENTITIES",
    "MARTS",
    "QUERIES",
    "OrderDocuments",
    "Shop",
    "bind",
    "build_all",
    "build_once",
    "builder",
    "land_parquet",
    "order_documents",
    "quality_report",
    "read_shop_csv",
    "read_shop_parquet",
    "run",
]
