"""Quotients rounded once, half away from zero, as NUMERIC does.

Spark gives a wide decimal quotient only 6 to 8 fraction digits, so rounding it
again can move a value that lies just under a half cent. Here the remainder is
taken off first: what is left divides without a rest, so that the one rounding
is exact. Every step is a decimal; where 38 digits do not hold one, it is an
error and never a wrong number.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_quotient(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` with ``digits`` fraction digits; NULL where ``den`` is 0."""
    den = F.nullif(den, F.lit(0))
    half = F.abs(den) * F.lit(Decimal(1))
    # num / den + 1/2 of the last digit, as a fraction of two decimals.
    top = F.abs(num) * F.lit(Decimal(2 * 10**digits)) + half
    bottom = half * F.lit(Decimal(2))
    size = (top - top % bottom) / bottom
    whole = F.when((num < 0) != (den < 0), -size).otherwise(size).cast("decimal(30,0)")
    quotient = (whole * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(30,{digits})")
    # With ANSI mode off a decimal that does not fit becomes NULL.
    lost = num.isNotNull() & den.isNotNull() & quotient.isNull()
    return F.when(lost, F.raise_error(F.lit("a quotient has more than 38 digits"))).otherwise(
        quotient
    )


def percent(num: Column, den: Column) -> Column:
    """``num`` as a percentage of ``den``, two digits; NULL where ``den`` is 0."""
    return half_up_quotient(num * F.lit(Decimal(100)), den, 2)


def mean(total: Column, n: Column, digits: int) -> Column:
    """Mean from a sum and a count; NULL for no rows."""
    return half_up_quotient(total, n, digits)
