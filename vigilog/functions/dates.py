"""A grammar of written dates and times, as column expressions and for single values alike.

A value is an optional weekday, a date, an optional time and an optional zone.
Dates are year first, or two numbers and a year, or hold a month's name; of two
numbers before a year the first is the month unless only the second can be.
Years of two digits are those from 1969 to 2068.  Times may lack seconds, have
fractions and am or pm; zones are UTC, GMT, Z or an offset, and make the value an
instant.  A time without a zone is one of UTC.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAME = "(" + "|".join(MONTHS) + ")[a-z]*[.]?"
_DAY_OF_WEEK = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]*\s+)?"
_CLOCK = r"(?:(?:\s*,\s*|\s+|t|:)(?:at\s+)?(\d{1,2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?\s*([ap])?[.]?(?:m[.]?)?)?"
_ZONE = r"\s*(z|utc|gmt|(?:utc|gmt)?[+-]\d{2}:?\d{2}|[+-]\d{2})?(?:\s*\([a-z]+\))?"
#: Patterns of dates, and which of their three parts is the year, the month and the day; "either" for two numbers before a year.
DATES = [
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    (r"(\d{4})(\d{2})(\d{2})", "ymd"),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", "either"),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?[-/ ]\s*{_NAME}[-/, ]\s*(\d{{4}}|\d{{2}})", "dmy"),
    (rf"{_NAME}[-/ ]\s*(\d{{1,2}})(?:st|nd|rd|th)?[-/, ]\s*(\d{{4}})", "mdy"),
    (rf"(\d{{4}})[-/ ]{_NAME}[-/ ](\d{{1,2}})", "ymd"),
]
PATTERNS = [(rf"^\s*{_DAY_OF_WEEK}{date}{_CLOCK}{_ZONE}\s*$", order) for date, order in DATES]


def parse(v: Column) -> Column:
    """The timestamp that a text stands for, null if none."""
    low = F.lower(v)

    def one(pattern: str, order: str) -> Column:
        part = lambda i: F.regexp_extract(low, pattern, i)
        number = lambda c: c.try_cast("int")
        if order == "either":
            a, b, year = number(part(1)), number(part(2)), part(3)
            swap = (a > 12) & (b <= 12)
            month, day = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
        else:
            year, month, day = (part(order.index(x) + 1) for x in "ymd")
            month, day = F.coalesce(number(month), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)), F.lit(0)).cast("int")), number(day)
        y = number(year)
        y = F.when(F.char_length(year) == 2, F.when(y < 69, y + 2000).otherwise(y + 1900)).otherwise(y)
        half = part(8)
        hour = F.coalesce(number(part(4)), F.lit(0))
        hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(None)).when(half == "p", hour % 12 + 12).otherwise(hour % 12)
        seconds = F.concat(F.when(part(6) == "", "0").otherwise(part(6)), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0")).try_cast("decimal(8,6)")
        made = F.try_make_timestamp(y, month, day, hour, F.coalesce(number(part(5)), F.lit(0)), seconds, F.lit("UTC"))
        zone = F.regexp_replace(part(9), "[a-z:]", "")
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        away = sign * (F.coalesce(number(F.substring(zone, 2, 2)), F.lit(0)) * 60 + F.coalesce(number(F.substring(zone, 4, 2)), F.lit(0)))
        return F.when(low.rlike(pattern), F.timestamp_micros(F.unix_micros(made) - away.cast("long") * 60_000_000))

    # the first pattern that fits, as they don't overlap
    return reduce(lambda a, b: F.coalesce(a, b), [one(*p) for p in PATTERNS])


def parse_one(text: str) -> datetime | None:
    """The same for one text."""
    low = text.lower()
    for pattern, order in PATTERNS:
        m = re.match(pattern, low)
        if not m:
            continue
        parts = m.groups()
        if order == "either":
            a, b, year = parts[:3]
            month, day = (int(b), int(a)) if int(a) > 12 >= int(b) else (int(a), int(b))
        else:
            year, month, day = (parts[order.index(x)] for x in "ymd")
            month, day = (int(month) if month.isdigit() else MONTHS.index(month[:3]) + 1), int(day)
        y = int(year) if len(year) > 2 else int(year) + (2000 if int(year) < 69 else 1900)
        hour, minute, second, fraction, half, zone = parts[3:]
        hour = int(hour or 0)
        if half:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (half == "p")
        sign = re.sub("[a-z:]", "", zone or "")
        away = (-1 if sign[:1] == "-" else 1) * (int(sign[1:3] or 0) * 60 + int(sign[3:5] or 0))
        try:
            made = datetime(y, month, day, hour, int(minute or 0), int(second or 0), int((fraction or "0")[:6].ljust(6, "0")), timezone.utc)
        except ValueError:
            return None
        return made - timedelta(minutes=away)
    return None
