"""The eight role tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from orderloom.sources.catalog import DATASETS

Source = DataFrame | Callable[[], DataFrame]


class Shop:
    """Role tables with the catalog's column names; keys may be of any one type.

    A table may be given as a function, which is called when the table is first
    used. ``order_totals`` holds the item totals per order when they have been
    written once for several marts.
    """

    def __init__(self, order_totals: DataFrame | None = None, **sources: Source) -> None:
        if set(sources) != set(DATASETS):
            raise ValueError(f"expected the tables {', '.join(DATASETS)}")
        self.order_totals = order_totals
        self._sources = sources

    def table(self, name: str) -> DataFrame:
        if name not in self._sources:
            raise KeyError(f"unknown dataset: {name}")
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in DATASETS}

    def with_order_totals(self, totals: DataFrame) -> Shop:
        return Shop(totals, **self._sources)

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def sellers(self) -> DataFrame:
        return self.table("sellers")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def category_translation(self) -> DataFrame:
        return self.table("category_translation")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self.table("order_items")

    @property
    def order_payments(self) -> DataFrame:
        return self.table("order_payments")

    @property
    def order_reviews(self) -> DataFrame:
        return self.table("order_reviews")
