"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column | str) -> Column:
    return F.to_date(ts)


def month_start(ts: Column | str) -> Column:
    """First day of the month: the join and grouping key (a 4-byte date)."""
    return F.trunc(F.to_date(ts), "month")


def month_key(ts: Column | str) -> Column:
    """'YYYY-MM' text, for output."""
    return F.date_format(ts, "yyyy-MM")


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(end, start)
