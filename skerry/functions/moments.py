"""Moments and their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.2425 * 86400
#: Seconds that a moment of each precision may be off.
SPANS = {
    "decade": 10 * YEAR,
    "year": YEAR,
    "month": YEAR / 12,
    "day": 86400.0,
    "hour": 3600.0,
    "minute": 60.0,
    "second": 1.0,
    "subsecond": 0.001,
}
#: The first Monday after the epoch's start, in seconds.
MONDAY = 345_600


def bin_of(seconds: Column, width: float, anchor: float = 0.0) -> Column:
    """Start of the bin of `width` seconds; truncates towards the anchor."""
    return (((seconds - F.lit(anchor)) / F.lit(width)).cast("long") * F.lit(int(width)) + F.lit(int(anchor))).cast("long")


def name_day(name: Column) -> Column:
    """The day (yyyy-MM-dd) that a name carries as 8 digits or 4-2-2, if it is a real one."""
    found = F.regexp_extract(name, r"(?:^|\D)((?:18|19|20)\d\d)[-_.]?(\d\d)[-_.]?(\d\d)(?:\D|$)", 0)
    digits = F.regexp_replace(found, r"\D", "")
    return F.date_format(F.try_to_date(F.when(F.length(digits) == 8, digits), "yyyyMMdd"), "yyyy-MM-dd")


def refined(claim: Column, precision: Column, estimate: Column) -> Column:
    """The estimate where it lies inside the claim's span, else the claim."""
    width = F.create_map(*[x for k, v in SPANS.items() for x in (F.lit(k), F.lit(v))])[precision]
    return F.when((estimate >= claim) & (estimate < claim + width), estimate).otherwise(claim)


def duration(text: Column) -> Column:
    """Seconds of a length written as `64.33 sec` or `2.13 min`, else null."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(sec|min)\w*\.?\s*$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(F.regexp_extract(text, pattern, 2) == "min", number * 60).otherwise(number)


def degrees(parts: Column, side: Column) -> Column:
    """Degrees from an array of degrees, minutes and seconds; south and west are negative."""
    whole = F.get(parts, F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)), F.lit(0.0)) / 60 + F.coalesce(F.get(parts, F.lit(2)), F.lit(0.0)) / 3600
    return F.when(F.upper(side).isin("S", "W"), -whole).otherwise(whole)


def rational(text: Column) -> Column:
    """A number, or a fraction like 1/250; null over a zero."""
    up, down = F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double")
    return F.when(text.contains("/"), F.when(down != 0, up / down)).otherwise(text.try_cast("double"))


def try_number(text: Column) -> Column:
    """A finite number, or null: no underscores, no words, at least one digit."""
    plain = F.trim(text)
    value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)
