"""Digests of rows agree with DISTINCT, and keep wide columns out of the shuffle."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from support import rows

from arrearly.functions.digests import row_digest
from arrearly.operators.activity import CALL_COLUMNS, contact_activity, distinct_interactions
from arrearly.params import AGREEMENT_CODES, RPC_CODES
from catalog.fixtures import SPAN

SCHEMA = (
    "s string, t string, b boolean, i int, l bigint, d double, m decimal(9,2), "
    "day date, z timestamp, n timestamp_ntz, raw binary"
)


def test_digest_tells_apart_what_distinct_does(spark):
    at = datetime(1996, 6, 1, 2, 30, 0, 123456)
    base = ["a", "b", True, 1, 2, 0.5, Decimal("1.20"), at.date(), at, at, b"x"]
    other = ["ab", "", False, 2, 1, float("nan"), Decimal("1.21"), datetime(1996, 6, 2).date(),
             at.replace(microsecond=123457), at.replace(microsecond=1), b""]
    data = [base, base, ["", "ab", *base[2:]], ["ab", "", *base[2:]], ["1:a", None, *base[2:]], [None, "1:a", *base[2:]]]
    data += [[*base[:i], x, *base[i + 1 :]] for i, o in enumerate(other) for x in (o, None)]
    data += [[*base[:5], zero, *base[6:]] for zero in (0.0, -0.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert df.select(row_digest(df)).distinct().count() == df.distinct().count()
    assert df.distinct().count() == len(data) - 2  # a row that is there twice, and two zeros


def test_local_times_that_repeat(spark):
    df = spark.createDataFrame([(846378000,), (846381600,)], "s long").selectExpr("timestamp_seconds(s) AS z")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(row_digest(df)).distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_nested_columns_have_no_digest(spark):
    assert row_digest(spark.range(1).withColumn("x", F.array("id"))) is None


def wide(df, columns=10):
    return df.withColumns({f"foreign_{i}": F.repeat(F.lit("x"), 200) for i in range(columns)})


def exchanged(df):
    """The columns of the widest shuffled row below the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    return max((line for line in text.splitlines() if "HashAggregate(keys=[" in line), key=len)


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_shuffled_rows_do_not_grow_with_foreign_columns(spark, static, random_tables, tmp_path):
    wide(random_tables.interactions, 30).write.parquet(str(tmp_path / "wide"))
    events = spark.read.parquet(str(tmp_path / "wide"))
    counts = contact_activity(events, "O", RPC_CODES, AGREEMENT_CODES, SPAN)
    lines = counts._jdf.queryExecution().executedPlan().toString().splitlines()
    for line in lines:
        if "HashAggregate" in line or "Exchange" in line:
            assert "foreign_" not in line
    scan = next(x for x in lines if "FileScan" in x)
    assert "EqualTo(kind,O)" in scan and "foreign_29" in scan  # compared, not shuffled


@pytest.mark.parametrize("columns", [0, 10])
def test_same_counts(random_tables, columns):
    """Copies that differ in a foreign column alone are different events."""
    events = wide(random_tables.interactions, columns)
    differing = events.withColumn("foreign_x", F.monotonically_increasing_id().cast("string"))
    for df in (events, differing):
        want = contact_activity(df.dropDuplicates(), "O", RPC_CODES, AGREEMENT_CODES, SPAN)
        assert rows(contact_activity(df, "O", RPC_CODES, AGREEMENT_CODES, SPAN)) == rows(want)
        assert distinct_interactions(df, CALL_COLUMNS).columns == list(CALL_COLUMNS)
