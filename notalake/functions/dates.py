"""Date spellings and the natural-language lower bound of a search."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what already counts as ISO.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?)?$"
# Fixed value: two-digit years from here on belong to 19xx.
CENTURY_PIVOT = 70


def _calendar_day(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the three numbers do not name a day."""
    text = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    )
    plausible = month.between(1, 12) & day.between(1, 31) & year.between(1, 9999)
    return F.when(plausible, text.try_cast("date"))


def _midnight(day: Column) -> Column:
    return F.when(day.isNotNull(), F.concat(day.cast("string"), F.lit("T00:00:00Z")))


def iso_date(text: Column) -> Column:
    """ISO passes through (blank -> T), DD/MM/YYYY and DD/MM/YY are converted, all else is NULL."""
    trimmed = F.trim(text)
    shape = r"^(\d{1,9})/(\d{1,9})/\s*(\d{4}|\d{2})\s*$"
    part = lambda i: F.regexp_extract(trimmed, shape, i).try_cast("int")
    digits = F.length(F.regexp_extract(trimmed, shape, 3))
    short = part(3)
    year = F.when(digits == 2, short + F.when(short >= CENTURY_PIVOT, 1900).otherwise(2000)).otherwise(short)
    return F.when(trimmed.rlike(ISO_PATTERN), F.replace(trimmed, F.lit(" "), F.lit("T"))).when(
        trimmed.rlike(shape), _midnight(_calendar_day(year, part(2), part(1)))
    )


def storage_date(text: Column) -> Column:
    """Coercion on save: DD/MM/YYYY, or D/M/YY with a one-digit day or month; whatever fails stays as it is."""
    long_shape, short_shape = r"^(\d{2})/(\d{2})/(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    part = lambda shape, i: F.regexp_extract(text, shape, i).try_cast("int")
    short_year = part(short_shape, 3)
    # strptime's own pivot for %y: 69 and above are 19xx.
    full_year = short_year + F.when(short_year >= 69, 1900).otherwise(2000)
    both_two_digits = text.rlike(r"^\d{2}/\d{2}/")
    long_day = _midnight(_calendar_day(part(long_shape, 3), part(long_shape, 2), part(long_shape, 1)))
    short_day = _midnight(_calendar_day(full_year, part(short_shape, 2), part(short_shape, 1)))
    return (
        F.when(text.rlike(long_shape), F.coalesce(long_day, text))
        .when(text.rlike(short_shape) & ~both_two_digits, F.coalesce(short_day, text))
        .otherwise(text)
    )


def recognised_date(text: Column) -> Column:
    """DD/MM/YYYY[ HH:MM[:SS]] of recognised text as `YYYY-MM-DD HH:MM:SS`; not checked against the calendar."""
    shape = r"^(\d+)/(\d+)/(\d+)(?:\s+(\S+))?$"
    trimmed = F.trim(text)
    part = lambda i: F.regexp_extract(trimmed, shape, i)
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    clock = part(4)
    colons = F.length(clock) - F.length(F.replace(clock, F.lit(":"), F.lit("")))
    time = F.when(clock == "", F.lit("00:00:00")).when(colons == 1, F.concat(clock, F.lit(":00"))).otherwise(clock)
    return F.when(
        trimmed.rlike(shape), F.concat(part(3), F.lit("-"), two(part(2)), F.lit("-"), two(part(1)), F.lit(" "), time)
    )


def lower_bound(phrase: str | None, as_of: datetime) -> datetime | None:
    """`hoje`, `ontem`, `últimos N dias` -> earliest moment of interest. Resolved once, on the driver."""
    if not phrase:
        return None
    wanted = phrase.lower()
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if "hoje" in wanted:
        return midnight
    if "ontem" in wanted:
        return midnight - timedelta(days=1)
    span = re.search(r"últimos (\d+) dias", wanted)
    return as_of - timedelta(days=int(span.group(1))) if span else None
