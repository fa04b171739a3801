"""Loads of the business tables: key renaming, enrichment, date cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.moments import iso_moment

# A text column is read as dates when its name contains one of these.
DATE_NAME_PARTS = ("_date", "_timestamp", "_at")


def keyed(table: DataFrame, key: str) -> DataFrame:
    """The table with its key renamed to ``_id`` and moved to the end."""
    return table.select(*[c for c in table.columns if c != key], F.col(key).alias("_id"))


def products_enriched(products: DataFrame, translations: DataFrame) -> DataFrame:
    """Products with their English category; every translation of a category gives a row."""
    names = translations.select("product_category_name", "product_category_name_english")
    joined = products.join(names, "product_category_name", "left")
    return joined.select(*products.columns, "product_category_name_english")


def clean_dates(table: DataFrame) -> DataFrame:
    """Dates become midnights; text in date-named columns becomes timestamps.

    A column has one type, so a text column is converted only when every value
    in it can be read; one pass over the candidate columns decides that.
    """
    texts = [
        f.name
        for f in table.schema.fields
        if isinstance(f.dataType, T.StringType) and any(part in f.name for part in DATE_NAME_PARTS)
    ]
    readable = set()
    if texts:
        unread = [
            F.coalesce(F.max(F.col(c).isNotNull() & iso_moment(F.col(c)).isNull()), F.lit(False)).alias(c) for c in texts
        ]
        bad = table.agg(*unread).first()
        readable = {c for c in texts if not bad[c]}

    def cleaned(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return column.cast("timestamp_ntz").alias(field.name)
        return iso_moment(column).alias(field.name) if field.name in readable else column

    return table.select(*[cleaned(f) for f in table.schema.fields])
