from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from arrearly.functions import bands


def apply(spark, schema, values, column):
    """``column`` over one row per value, in order."""
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"row int, {schema}")
    return [r.x for r in df.select("row", column.alias("x")).orderBy("row").collect()]


def test_risk_bucket(spark):
    values = [(0,), (1,), (6,), (7,), (40,), (-1,), (None,)]
    assert apply(spark, "n int", values, bands.risk_bucket("n")) == [1, 1, 6, 7, 7, -1, 7]


def test_strip_check_digit(spark):
    values = [(57,), (59,), (60,), (9,), (None,), (9223372036854775807,)]
    got = apply(spark, "n bigint", values, bands.strip_check_digit("n"))
    assert got == [5, 5, 6, 0, None, 922337203685477580]


def test_age_bracket(spark):
    values = [(24,), (25,), (40,), (41,), (60,), (61,), (None,)]
    assert apply(spark, "n int", values, bands.age_bracket("n")) == [
        "1. < 25 years", "2. 25-40 years", "2. 25-40 years", "3. 41-60 years",
        "3. 41-60 years", "4. > 60 years", "4. > 60 years",
    ]
    short = bands.age_bracket("n", bands.AGE_BRACKETS_SHORT)
    assert apply(spark, "n int", [(30,)], short) == ["2. 25-40 yrs"]


def test_age_is_rounded(spark):
    on = date(2026, 6, 1)
    values = [(date(2000, 6, 1),), (date(2000, 11, 25),), (date(2000, 12, 10),), (None,)]
    assert apply(spark, "d date", values, bands.age_years("d", F.lit(on))) == [26, 26, 25, None]


def test_saturation(spark):
    values = [(D("19.99"),), (D(20),), (D(60),), (D("60.01"),), (None,)]
    got = apply(spark, "p decimal(5,2)", values, bands.saturation_range("p"))
    assert got == [
        bands.SATURATION_LOW, bands.SATURATION_MEDIUM, bands.SATURATION_MEDIUM,
        bands.SATURATION_HIGH, bands.SATURATION_HIGH,
    ]


def test_contact_recency(spark):
    on = date(2026, 6, 30)
    days = {-1: 0, 7: 0, 8: 1, 30: 1, 31: 2}
    values = [(date.fromordinal(on.toordinal() - n),) for n in days] + [(None,)]
    labels = [bands.RECENCY_RECENT, bands.RECENCY_MODERATE, bands.RECENCY_NONE]
    got = apply(spark, "d date", values, bands.contact_recency_range("d", F.lit(on)))
    assert got == [labels[i] for i in days.values()] + [bands.RECENCY_NONE]


def test_financial_load(spark):
    schema = "b decimal(12,2), i decimal(12,2)"
    values = [
        (D("19.99"), D(100)), (D(20), D(100)), (D(50), D(100)), (D("50.01"), D(100)),
        (D(1), D(0)), (D(1), None),
    ]
    assert apply(spark, schema, values, bands.financial_load_tier("b", "i")) == [
        bands.LOAD_LOW, bands.LOAD_MEDIUM, bands.LOAD_MEDIUM, bands.LOAD_HIGH,
        bands.LOAD_HIGH, bands.LOAD_HIGH,
    ]
    assert apply(spark, schema, values, bands.financial_load_pct("b", "i")) == [
        D("19.99"), D("20.00"), D("50.00"), D("50.01"), None, None,
    ]


def test_contactability_has_a_gap(spark):
    values = [(D(70),), (D("69.5"),), (D(69),), (D(30),), (D("29.9"),), (None,)]
    got = apply(spark, "s decimal(5,1)", values, bands.contactability_tier("s"))
    assert got == [
        bands.CONTACTABILITY_HIGH, bands.CONTACTABILITY_LOW, bands.CONTACTABILITY_MEDIUM,
        bands.CONTACTABILITY_MEDIUM, bands.CONTACTABILITY_LOW, bands.CONTACTABILITY_LOW,
    ]


def test_labels(spark):
    values = [(10,), (None,)]
    assert apply(spark, "n int", values, bands.score_tier_label("n")) == ["Score Tier 10", None]
    assert apply(spark, "n int", values, bands.bucket_label("n")) == ["Bucket 10", None]


def test_amount_due(spark):
    schema = "o decimal(12,2), f decimal(12,2), c decimal(12,2)"
    cases = [
        ((D(-5), D(7), D(-5)), D(7)),      # nothing overdue wins over equal balances
        ((D(0), D(7), D(90)), D(7)),
        ((D(50), D(7), D(50)), D(50)),
        ((D(50), D(7), D(90)), D(57)),
        ((D(50), D(7), D(52)), D(52)),
        ((D(50), D(7), None), D(57)),      # least skips NULL
        ((None, D(7), D(90)), None),
    ]
    got = apply(spark, schema, [c for c, _ in cases], bands.amount_due("o", "f", "c"))
    assert got == [want for _, want in cases]


def test_promise_end(spark):
    values = [
        (date(2026, 6, 1), 1), (date(2026, 6, 25), 1), (date(2026, 6, 1), 0),
        (date(2026, 6, 1), None),
    ]
    got = apply(spark, "d date, w int", values, bands.promise_end_date("d", "w"))
    assert got == [
        date(2026, 6, 8), date(2026, 6, 30), date(2026, 6, 1), date(2026, 6, 30),
    ]


@pytest.mark.parametrize(
    ("code", "want"), [(1, "Agreements"), (33, "System"), (2, "Unmapped"), (None, "Unmapped")]
)
def test_outcome_category(spark, code, want):
    taxonomy = {"Agreements": (1, 35), "System": (33,)}
    got = apply(spark, "n int", [(code,)], bands.outcome_category("n", taxonomy))
    assert got == [want]


def test_reason(spark):
    assert apply(spark, "n int", [(3,), (None,)], bands.reason_or_zero("n")) == [3, 0]
