from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrearly.functions.rounding import mean, percent

money = st.decimals(-(10**20), 10**20, places=2)


def exact(num, den, digits):
    with localcontext() as c:
        c.prec = 80
        if not den:
            return None
        return (num / den).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def quotients(spark, pairs):
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)],
        "i int, a decimal(36,2), b decimal(36,2)",
    )
    got = df.select("i", percent(F.col("a"), F.col("b")).alias("p")).orderBy("i")
    return [r.p for r in got.collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(money, money.map(lambda d: d or Decimal(1))), min_size=50, max_size=50))
def test_percent_is_exact(spark, pairs):
    assert quotients(spark, pairs) == [exact(a * 100, b, 2) for a, b in pairs]


def test_ties_and_near_ties(spark):
    pairs = [
        ("0.01", "2.00"),            # 0.5
        ("0.01", "200.00"),          # 0.005 -> 0.01
        ("-0.01", "200.00"),
        ("0.01", "-200.00"),
        ("1234499999999.99", "10000000000000.00"),   # just under 12.345
        ("1234500000000.00", "10000000000000.00"),
        ("5.00", "0.00"),
        (None, "5.00"),
    ]
    got = quotients(spark, [tuple(x and Decimal(x) for x in p) for p in pairs])
    assert got == [
        Decimal("0.50"), Decimal("0.01"), Decimal("-0.01"), Decimal("-0.01"),
        Decimal("12.34"), Decimal("12.35"), None, None,
    ]


def test_beyond_64_bits(spark):
    """Around 2**63 in every place where a whole number of 64 bits would wrap."""
    edge = Decimal(2**63)
    values = [
        edge * s / Decimal(10**d) + Decimal(e).scaleb(-2)
        for d in (0, 2, 4, 6) for e in (-1, 0, 1) for s in (1, -1)
    ]
    values = [v.quantize(Decimal("0.01")) for v in values] + [Decimal("18446744073709551.00")]
    # The widest money that conform() admits, and the largest sum of it that fits.
    values += [Decimal("99999999999999999999.99"), Decimal("-99999999999999999999.99")]
    pairs = [(a, b) for a in values for b in (Decimal("1.00"), Decimal("-3.00"), Decimal("7.77"))]
    assert quotients(spark, pairs) == [exact(a * 100, b, 2) for a, b in pairs]
    df = spark.createDataFrame([(v, 1) for v in values], "s decimal(36,2), n bigint")
    got = [r.m for r in df.select(mean(F.col("s"), F.col("n"), 6).alias("m")).collect()]
    assert got == values


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_what_does_not_fit_is_an_error(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        huge = spark.createDataFrame([(Decimal(10**33), Decimal("0.01"))], "a decimal(36,2), b decimal(36,2)")
        with pytest.raises(Exception, match="digits|NUMERIC_VALUE_OUT_OF_RANGE|OVERFLOW"):
            huge.select(percent(F.col("a"), F.col("b"))).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_mean(spark):
    df = spark.createDataFrame(
        [(Decimal("10.00"), 3), (Decimal("0.05"), 2), (None, 0)], "s decimal(36,2), n bigint"
    )
    got = [r.m for r in df.select(mean(F.col("s"), F.col("n"), 6).alias("m")).collect()]
    assert got == [Decimal("3.333333"), Decimal("0.025000"), None]
    got = [r.m for r in df.select(mean(F.col("s"), F.col("n"), 2).alias("m")).collect()]
    assert got == [Decimal("3.33"), Decimal("0.03"), None]
