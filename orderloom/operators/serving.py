"""Bounded reads: pages, lookups and the first rows of a mart."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from orderloom.operators.contracts import MARTS, ORDER_STATUSES, Contract, conform, normalize, served

MAX_SIZE = 100
DEFAULT_SIZE = 20

# Beyond this many skipped rows a page first looks up the key it starts at.
SHALLOW_ROWS = 100_000
SEEK_RANGES = 2_000


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    page: int
    size: int
    total_pages: int


def check_bounds(name: str, value: int, low: int, high: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        bounds = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{name} must be {bounds}, got {value!r}")


def check_status(status: str) -> str:
    if status not in ORDER_STATUSES:
        raise ValueError(f"unknown order status: {status!r}")
    return status


def filtered(table: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Rows equal to every given value; an absent filter (None) does not restrict."""
    for column, value in (filters or {}).items():
        if value is not None:
            table = table.where(F.col(column) == F.lit(value))
    return table


def offset_rows(
    table: DataFrame, key: str, skip: int, limit: int, shallow: int = SHALLOW_ROWS, ranges: int = SEEK_RANGES
) -> DataFrame:
    """``limit`` rows in key order after the first ``skip``.

    A top-k keeps ``skip + limit`` rows, so a deep page first finds the key it
    starts near: the keys are range-partitioned and counted per range, again
    within the range that holds row ``skip``, until few rows are left to skip.
    Only one row per range reaches the driver.
    """
    scope, start = table.select(key), None
    while skip > shallow:
        found = _seek(scope, key, skip, ranges)
        if found is None:
            return table.limit(0)
        held, before, narrowed = found
        if not narrowed:
            break
        skip -= before
        start = held["first"]
        scope = scope.where(F.col(key).between(F.lit(start), F.lit(held["last"])))
    if start is not None:
        table = table.where(F.col(key) >= F.lit(start))
    return table.orderBy(F.asc_nulls_first(key)).offset(skip).limit(limit)


def _seek(keys: DataFrame, key: str, skip: int, ranges: int) -> tuple[Row, int, bool] | None:
    """The key range that holds row ``skip``, the rows before it, and whether it narrows the search."""
    by_range = (
        keys.repartitionByRange(ranges, F.asc_nulls_first(key))
        .groupBy(F.spark_partition_id().alias("range"))
        .agg(
            F.min(key).alias("first"),
            F.max(key).alias("last"),
            F.count(F.lit(1)).alias("rows"),
            F.count(key).alias("keyed"),
        )
        .orderBy("range")
    )
    before, counted = 0, by_range.collect()
    for row in counted:
        if before + row["rows"] > skip:
            # Rows without a key sort first and cannot be sought.
            return row, before, len(counted) > 1 and row["keyed"] == row["rows"]
        before += row["rows"]
    return None


def page(
    table: DataFrame,
    key: str = "_id",
    page: int = 1,
    size: int = DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
) -> Page:
    """One page in key order with the total number of rows."""
    check_bounds("page", page, 1)
    check_bounds("size", size, 1, MAX_SIZE)
    rows = filtered(table, filters)
    total = rows.count()
    skip = (page - 1) * size
    # Beyond the last page there is nothing to look for.
    items = offset_rows(rows, key, skip, size) if skip < total else rows.limit(0)
    return Page(items, total, page, size, ceil(total / size) if total else 1)


def orders_page(documents: DataFrame, page_number: int = 1, size: int = DEFAULT_SIZE, status: str | None = None) -> Page:
    """A page of orders, of one status when given."""
    filters = {"order_status": None if status is None else check_status(status)}
    return page(documents, "_id", page_number, size, filters)


def page_after(
    table: DataFrame,
    key: str = "_id",
    last: Any = None,
    limit: int = DEFAULT_SIZE,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The next ``limit`` rows after key ``last``; an empty ``last`` starts at the beginning.

    ``last`` takes the place of a filter on the key. This reads as much for the
    millionth page as for the first and is the way to walk a large table.
    """
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit!r}")
    filters = dict(filters or {})
    if last is not None and last != "":
        filters.pop(key, None)
        table = table.where(F.col(key) > F.lit(last))
    return filtered(table, filters).orderBy(F.asc_nulls_first(key)).limit(limit)


def by_key(table: DataFrame, value: Any, key: str = "_id") -> DataFrame:
    """The row with this key; no rows when there is none."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def orders_of_customer(documents: DataFrame, customer_id: Any, limit: int = DEFAULT_SIZE) -> DataFrame:
    """Newest orders of one customer; equal times are ordered by key."""
    check_bounds("limit", limit, 1, MAX_SIZE)
    return (
        documents.where(F.col("customer_id") == F.lit(customer_id))
        .orderBy(F.desc_nulls_last("order_purchase_timestamp"), "_id")
        .limit(limit)
    )


def first_of_mart(mart: DataFrame, name: str, limit: int = DEFAULT_SIZE) -> DataFrame:
    """The first rows of a mart by ``_id``, normalised and shaped to its contract.

    The limit is applied before a NULL key takes its fallback, so a row without
    key, which sorts first, takes a place.
    """
    check_bounds("limit", limit, 1, MAX_SIZE)
    contract: Contract = MARTS[name]
    first = served(mart, contract).orderBy(F.asc_nulls_first("_id")).limit(limit)
    return conform(normalize(first, contract), contract).orderBy(F.asc_nulls_first("_id"))
