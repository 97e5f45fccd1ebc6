"""Clock text to minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hour and minute, one or two digits each.
CLOCK_PATTERN = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])$"


#: White space of any kind at either end.
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column | str) -> Column:
    """Text without white space around it: tabs and non-breaking spaces too, which ``trim`` leaves."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def clock_is_bad(text: Column) -> Column:
    """Filled in, but not a time of day."""
    return ~is_blank(text) & ~stripped(text).rlike(CLOCK_PATTERN)


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight; NULL for blank or bad text."""
    clean = stripped(text)
    hour = F.regexp_extract(clean, CLOCK_PATTERN, 1).try_cast("int")
    minute = F.regexp_extract(clean, CLOCK_PATTERN, 2).try_cast("int")
    return F.when(clean.rlike(CLOCK_PATTERN), hour * 60 + minute)
