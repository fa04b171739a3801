"""Date and time expressions on zone-less timestamps.

None of them depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"

# The ISO 8601 texts accepted as a moment. Date and time have an extended form
# with separators and a basic one without; a week date may lack its day, and stands for Monday.
ISO_DATE = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)"
ISO_CLOCK = (
    r"(?:(\d{2}):(\d{2}):(\d{2})[.,](\d+)|(\d{2}):(\d{2}):(\d{2})|(\d{2}):(\d{2})"
    r"|(\d{2})(\d{2})(\d{2})[.,](\d+)|(\d{2})(\d{2})(\d{2})|(\d{2})(\d{2})|(\d{2}))"
)
ISO_OFFSET = r"(?:(Z)|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?)"
ISO_MOMENT = f"^{ISO_DATE}(?:[^0-9]{ISO_CLOCK}{ISO_OFFSET}?)?$"
# Where the groups of the pattern are.
YEARS, MONTHS, MONTH_DAYS = (1, 4), (2, 5), (3, 6)
WEEK_YEARS, WEEKS, WEEK_DAYS = (7, 10), (8, 11), (9, 12)
HOURS, MINUTES, SECONDS, FRACTIONS = (13, 17, 20, 22, 26, 29, 31), (14, 18, 21, 23, 27, 30), (15, 19, 24, 28), (16, 25)
SIGN, OFFSET_HOURS, OFFSET_MINUTES, OFFSET_SECONDS, OFFSET_FRACTION = ((group,) for group in range(33, 38))
PARTS = [
    *(YEARS, MONTHS, MONTH_DAYS, WEEK_YEARS, WEEKS, WEEK_DAYS, HOURS, MINUTES, SECONDS, FRACTIONS),
    *(SIGN, OFFSET_HOURS, OFFSET_MINUTES, OFFSET_SECONDS, OFFSET_FRACTION),
]
# All parts, each closed by a comma, which none of them holds; a line end that the pattern lets pass comes behind the last.
WRITTEN_PARTS = "".join("".join(f"${group}" for group in groups) + "," for groups in PARTS)


def zoneless(value: str) -> str:
    """SQL for a zone-less timestamp; unreadable text is an error."""
    return f"cast({value} as timestamp_ntz)"


def month_start(moment: str) -> str:
    """SQL for the first midnight of the month. (``date_trunc`` would return a zoned timestamp.)"""
    return f"cast(trunc(cast({moment} as date), 'MM') as timestamp_ntz)"


def days_between(start: str, end: str) -> str:
    """SQL for the midnights crossed from ``start`` to ``end``: 23:30 to 00:30 is one day."""
    return f"datediff(cast({end} as date), cast({start} as date))"


def iso_moment(text: Column) -> Column:
    """ISO date or timestamp text as a zone-less timestamp, NULL when it is not one.

    Read are calendar and week dates, each extended or basic, with a time of hours to
    fractions of any length (beyond microseconds cut off) behind any one character
    that is no digit. Text with an offset becomes UTC wall time.
    """
    trimmed = F.btrim(text, F.lit(BLANKS))
    # One match writes all parts, and a transform over one element reads them: a match per part is many times slower.
    found = F.when(trimmed.rlike(ISO_MOMENT), F.split(F.regexp_replace(trimmed, ISO_MOMENT, WRITTEN_PARTS), ","))
    return F.element_at(F.transform(F.array(found), _moment), 1)


def _moment(parts: Column) -> Column:
    """The moment that the written parts of a text stand for; NULL for NULL, or when there is no such moment."""

    def part(groups: tuple[int, ...]) -> Column:
        """The group that took part, of those that cannot both; empty when none did."""
        return F.get(parts, F.lit(PARTS.index(groups)))

    def number(groups: tuple[int, ...]) -> Column:
        # Behind a zero, since a cast of empty text costs an exception.
        return F.concat(F.lit("0"), part(groups)).cast("bigint")

    def micros(hours: Column, minutes: Column, seconds: Column, fraction: Column) -> Column:
        return ((hours * 60 + minutes) * 60 + seconds) * 1_000_000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("bigint")

    calendar = F.concat_ws("-", part(YEARS), part(MONTHS), part(MONTH_DAYS)).try_cast("date")
    week, day = number(WEEKS), F.when(part(WEEK_DAYS) == "", F.lit(1).cast("bigint")).otherwise(number(WEEK_DAYS))
    # The fourth of January is always in the first week.
    fourth = F.concat(part(WEEK_YEARS), F.lit("-01-04")).try_cast("date")
    counted = F.date_add(fourth, ((week - 1) * 7 + day - 1).cast("int") - F.weekday(fourth))
    by_week = F.when((F.weekofyear(counted) == week) & day.between(1, 7), counted)
    date = F.when(part(YEARS) != "", calendar).otherwise(by_week)

    hours, minutes, seconds = number(HOURS), number(MINUTES), number(SECONDS)
    off = [number(groups) for groups in (OFFSET_HOURS, OFFSET_MINUTES, OFFSET_SECONDS)]
    fits = (hours < 24) & (minutes < 60) & (seconds < 60) & (off[0] < 24) & (off[1] < 60) & (off[2] < 60)
    sign = F.when(part(SIGN) == "-", -1).otherwise(1)
    since = micros(hours, minutes, seconds, part(FRACTIONS)) - sign * micros(*off, part(OFFSET_FRACTION))
    return F.when(parts.isNotNull() & fits, F.timestamp_add("MICROSECOND", since, date.cast("timestamp_ntz")))
