"""Month arithmetic on ``M/YYYY`` texts, in the three ways that career data needs it.

The research, runtime and service rules for months of experience differ on purpose.
All take and give Columns and stay within Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Open-ended research jobs end at most in this month (August 2021): year * 12 + month.
RESEARCH_LAST = 2021 * 12 + 8


def month_index(text: Column) -> Column:
    """year * 12 + month of ``M/YYYY``; null for null, ``current`` and anything else."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, parts[1].try_cast("int") * 12 + parts[0].try_cast("int"))


def month_index_strict(text: Column) -> Column:
    """Like ``month_index``, for months 1 to 12 and years of four digits only."""
    month = F.regexp_extract(text, r"^\s*(\d{1,2})\s*/\s*(\d{4})\s*$", 1).try_cast("int")
    year = F.regexp_extract(text, r"^\s*(\d{1,2})\s*/\s*(\d{4})\s*$", 2).try_cast("int")
    return F.when(month.between(1, 12), year * 12 + month)


def is_current(text: Column) -> Column:
    return F.lower(F.trim(text)) == "current"


def months_research(start: Column, end: Column) -> Column:
    """End minus start; ``current`` ends a year after the start, or in the last month
    of the data if that is earlier. May be negative; null if either date is missing."""
    first = month_index(start)
    last = F.when(end == "current", F.least(first + 12, F.lit(RESEARCH_LAST))).otherwise(month_index(end))
    return last - first


def months_runtime(start: Column, end: Column, given: Column | None = None) -> Column:
    """A given number wins; else as in research, with 0 where a date is missing."""
    first = month_index(start)
    last = F.when(is_current(end), F.least(first + 12, F.lit(RESEARCH_LAST))).otherwise(month_index(end))
    counted = F.coalesce((last - first).cast("double"), F.lit(0.0))
    return counted if given is None else F.coalesce(given.cast("double"), counted)


def months_service(start: Column, end: Column, as_of: Column | None = None) -> Column:
    """Months up to ``as_of`` (default: today) for open ends; never negative; null if
    the start is missing or the end is no date."""
    day = F.current_date() if as_of is None else as_of
    now = F.year(day) * 12 + F.month(day)
    open_end = end.isNull() | (F.trim(end) == "") | is_current(end)
    last = F.when(open_end, now).otherwise(month_index_strict(end))
    months = last - month_index_strict(start)
    return F.when(months.isNotNull(), F.greatest(months, F.lit(0)))  # greatest alone skips nulls


def expires_at(issued: Column, hours: int) -> Column:
    return issued + F.make_dt_interval(hours=F.lit(hours))


def valid_token(used: Column, expires: Column, now: Column) -> Column:
    return ~used & (expires >= now)
