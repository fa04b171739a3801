"""Pages, lookups and newest orders of written orders, by index.

The documents lie by customer; two narrow tables say where the orders of each key,
and of each status, lie. A read finds at most a page of places in these and opens
the files that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators.contracts import MARTS, Contract, conform, normalize, served
from orderloom.operators.ranged import PLACE, RANGE, RangedTable
from orderloom.operators.serving import DEFAULT_SIZE, MAX_SIZE, Page, check_bounds, check_status


@dataclass(frozen=True)
class OrderAccess:
    """``orders`` by customer, newest first; ``by_key`` and ``by_status`` hold the place of each order."""

    orders: RangedTable
    by_key: RangedTable
    by_status: RangedTable

    def page(self, page: int = 1, size: int = DEFAULT_SIZE, status: str | None = None) -> Page:
        """A page of orders in key order, of one status when given, with the number of all of them."""
        check_bounds("page", page, 1)
        check_bounds("size", size, 1, MAX_SIZE)
        index, group = self._index(status)
        total = index.total(group)
        found = index.at_rank((page - 1) * size, size, group)
        return Page(self._fetched(found), total, page, size, ceil(total / size) if total else 1)

    def after(self, last: Any = None, limit: int = DEFAULT_SIZE, status: str | None = None) -> DataFrame:
        """The next ``limit`` orders after key ``last``; NULL or empty starts at the beginning."""
        check_bounds("limit", limit, 1, MAX_SIZE)
        index, group = self._index(status)
        return self._fetched(index.after(last, limit, group=group))

    def by_id(self, value: Any) -> DataFrame:
        """The order with this key; no rows when there is none."""
        return self._fetched(self.by_key.equal(value))

    def of_customer(self, customer_id: Any, limit: int = DEFAULT_SIZE) -> DataFrame:
        """Newest orders of one customer; equal times are ordered by key."""
        check_bounds("limit", limit, 1, MAX_SIZE)
        return self.orders.equal(customer_id, "customer_id", limit)

    def _index(self, status: str | None) -> tuple[RangedTable, str | None]:
        return (self.by_key, None) if status is None else (self.by_status, check_status(status))

    def _fetched(self, found: DataFrame) -> DataFrame:
        """The documents of a page of index rows, in key order."""
        places = [tuple(row) for row in found.select("at_file", "at_range", "at_place").collect()]  # a page
        return self.orders.at_places(places).orderBy(F.asc_nulls_first("_id"), RANGE, PLACE).drop(RANGE, PLACE)


def first_of_built_mart(mart: RangedTable, name: str, limit: int = DEFAULT_SIZE) -> DataFrame:
    """The first rows of a written mart by ``_id``, normalised and shaped to its contract; one file is opened."""
    check_bounds("limit", limit, 1, MAX_SIZE)
    contract: Contract = MARTS[name]
    first = served(mart.at_rank(0, limit), contract)
    return conform(normalize(first, contract), contract).orderBy(F.asc_nulls_first("_id"))
