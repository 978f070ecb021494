"""Pure column rules: ids, bands, tiers and amounts.

Every band ends in an ELSE, so a NULL input (and a value in a gap between two
closed ranges) falls into the last band. The docstrings name the cases.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from arrearly.functions.calendar import days_between
from arrearly.functions.rounding import percent

# --- Fixed values: band labels --------------------------------------------
AGE_BRACKETS = ("1. < 25 years", "2. 25-40 years", "3. 41-60 years", "4. > 60 years")
AGE_BRACKETS_SHORT = ("1. < 25 yrs", "2. 25-40 yrs", "3. 41-60 yrs", "4. > 60 yrs")
SATURATION_LOW = "Low Saturation (<20%)"
SATURATION_MEDIUM = "Medium Saturation (20-60%)"
SATURATION_HIGH = "High Saturation (>60%)"
RECENCY_RECENT = "Recent Contact (<=7 days)"
RECENCY_MODERATE = "Moderate Contact (8-30 days)"
RECENCY_NONE = "No Recent Contact (>30 days)"
LOAD_LOW = "1. Low Load (<20%)"
LOAD_MEDIUM = "2. Medium Load (20-50%)"
LOAD_HIGH = "3. High Load (>50%)"
CONTACTABILITY_HIGH = "1. High Contactability (>=70 pts)"
CONTACTABILITY_MEDIUM = "2. Medium Contactability (30-69 pts)"
CONTACTABILITY_LOW = "3. Low Contactability (<30 pts)"
UNMAPPED = "Unmapped"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_check_digit(account_id: Column | str) -> Column:
    """Customer id: the account id without its last digit (integer division)."""
    return F.call_function("div", _col(account_id), F.lit(10))


def risk_bucket(past_due: Column | str) -> Column:
    """Buckets 1 to 7: 0 joins 1, 7 and more (and NULL) are 7, negatives stay."""
    n = _col(past_due)
    return F.when(n == 0, F.lit(1)).when(n < 7, n).otherwise(F.lit(7))


def reason_or_zero(code: Column | str) -> Column:
    return F.coalesce(_col(code), F.lit(0))


def age_years(birth: Column | str, on: Column | str) -> Column:
    """Whole years, rounded. A day count is never halfway between two ages."""
    return F.round(days_between(birth, on) / F.lit(365.25), 0).cast("int")


def age_bracket(age: Column | str, labels: Sequence[str] = AGE_BRACKETS) -> Column:
    """Four brackets; an unknown age falls in the last one."""
    n = _col(age)
    return (
        F.when(n < 25, labels[0])
        .when(n.between(25, 40), labels[1])
        .when(n.between(41, 60), labels[2])
        .otherwise(labels[3])
    )


def saturation_range(pct: Column | str) -> Column:
    """An unknown saturation is High."""
    n = _col(pct)
    return (
        F.when(n < 20, SATURATION_LOW)
        .when(n.between(20, 60), SATURATION_MEDIUM)
        .otherwise(SATURATION_HIGH)
    )


def contact_recency_range(last_contact: Column | str, on: Column | str) -> Column:
    """A contact after ``on`` is Recent; no contact is No Recent."""
    n = days_between(last_contact, on)
    return (
        F.when(n <= 7, RECENCY_RECENT)
        .when(n.between(8, 30), RECENCY_MODERATE)
        .otherwise(RECENCY_NONE)
    )


def financial_load(balance: Column | str, income: Column | str) -> Column:
    """Balance over monthly income; NULL for a zero or unknown income."""
    return _col(balance) / F.nullif(_col(income), F.lit(0))


def financial_load_pct(balance: Column | str, income: Column | str) -> Column:
    return percent(_col(balance), _col(income))


def financial_load_tier(balance: Column | str, income: Column | str) -> Column:
    """A zero or unknown income is High."""
    ratio = financial_load(balance, income)
    low, high = F.lit(Decimal("0.20")), F.lit(Decimal("0.50"))
    return (
        F.when(ratio < low, LOAD_LOW)
        .when(ratio.between(low, high), LOAD_MEDIUM)
        .otherwise(LOAD_HIGH)
    )


def contactability_tier(score: Column | str) -> Column:
    """No score is Low, and so is a score strictly between 69 and 70."""
    n = _col(score)
    return (
        F.when(n >= 70, CONTACTABILITY_HIGH)
        .when(n.between(30, 69), CONTACTABILITY_MEDIUM)
        .otherwise(CONTACTABILITY_LOW)
    )


def score_tier_label(rank: Column | str) -> Column:
    """NULL for an account without a score."""
    return F.concat(F.lit("Score Tier "), _col(rank).cast("string"))


def bucket_label(bucket: Column | str) -> Column:
    return F.concat(F.lit("Bucket "), _col(bucket).cast("string"))


def amount_due(
    overdue: Column | str, base_fee: Column | str, current: Column | str
) -> Column:
    """Amount a customer must pay now. The order of the branches matters; an
    unknown overdue balance gives NULL."""
    overdue, base_fee, current = _col(overdue), _col(base_fee), _col(current)
    return (
        F.when(overdue <= 0, base_fee)
        .when(current == overdue, overdue)
        .when(overdue > 0, F.least(overdue + base_fee, current))
    )


def promise_end_date(call_day: Column | str, term_weeks: Column | str) -> Column:
    """Call day plus the agreed weeks, no later than the month's last day.
    ``least`` skips NULL, so an open term ends with the month."""
    d = _col(call_day)
    return F.least(F.last_day(d), F.date_add(d, _col(term_weeks) * 7))


def outcome_category(
    code: Column | str, taxonomy: Mapping[str, Iterable[int]]
) -> Column:
    """Executive category of a call outcome code; codes in no list are Unmapped.

    There are a few dozen codes, so the taxonomy is an expression, not a join.
    """
    category = F.lit(None).cast("string")
    for name, codes in taxonomy.items():
        category = F.coalesce(category, F.when(_col(code).isin(*codes), F.lit(name)))
    return F.coalesce(category, F.lit(UNMAPPED))
