"""Lenient readings of stored values: whatever cannot be read becomes 0 or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.moments import BLANKS, iso_moment

# The decimal number texts accepted as a float or as an integer.
FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def as_float(value: Column, kind: T.DataType) -> Column:
    """Finite double, or NULL for anything else (NaN, infinities, blank or other text)."""
    if isinstance(kind, T.StringType):
        text = F.btrim(value, F.lit(BLANKS))
        number = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        number = value.cast("double")
    else:
        return _nothing("double")
    return F.when(F.abs(number) < float("inf"), number)


def as_money(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(as_float(value, kind), F.lit(0.0))


def as_count(value: Column, kind: T.DataType) -> Column:
    """Whole number truncated toward zero; 0 for anything unreadable."""
    if isinstance(kind, T.StringType):
        text = F.btrim(value, F.lit(BLANKS))
        number = F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))
    elif isinstance(kind, T.BooleanType):
        number = value.cast("bigint")
    elif isinstance(kind, T.NumericType):
        number = value.try_cast("bigint")
    else:
        number = _nothing("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def as_moment(value: Column, kind: T.DataType) -> Column:
    """Zone-less timestamp: a date is its midnight, ISO text is read, the rest is NULL."""
    if isinstance(kind, T.StringType):
        return iso_moment(value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp_ntz")
    return _nothing("timestamp_ntz")
