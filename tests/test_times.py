"""Times as text: what is read, what is set aside, and why."""

from datetime import date, datetime

import pytest
from support import rows

from arrearly import read_tables
from arrearly.sources.times import parse_times, parsed_time, rejected_counts

GOOD = {
    "iso": {
        "1996-06-01": datetime(1996, 6, 1),
        " 1996-06-01 09:05 ": datetime(1996, 6, 1, 9, 5),
        "1996-06-01T09:05:59": datetime(1996, 6, 1, 9, 5, 59),
        "1996-06-01 09:05:59.25": datetime(1996, 6, 1, 9, 5, 59, 250000),
        "1996-02-29 00:00:00.000001": datetime(1996, 2, 29, 0, 0, 0, 1),
        "1997-03-30 02:30:00": datetime(1997, 3, 30, 2, 30),  # not there in some zones
    },
    "compact": {"19960601": datetime(1996, 6, 1), "19960601 09:05": datetime(1996, 6, 1, 9, 5)},
    "day_first": {"01/06/1996": datetime(1996, 6, 1), "30.06.1996 23:59:59": datetime(1996, 6, 30, 23, 59, 59)},
    "month_first": {"06/30/1996": datetime(1996, 6, 30)},
}
BAD = {
    "iso": {
        "1997-02-29": "value", "1996-13-01": "value", "1996-06-31 10:00": "value",
        "1996-06-01 24:00": "value", "1996-06-01 10:61": "value",
        "": "form", "  ": "form", "n/a": "form", "1996-6-1": "form", "01/06/1996": "form",
        "1996-06-01 10": "form", "1996-06-01 10:00:00Z": "form", "1996-06-01 10:00:00.1234567": "form",
        "1996-06-01\\nx": "form",
    },
    "day_first": {"06/30/1996": "value", "1996-06-01": "form"},
}


@pytest.mark.parametrize("style", GOOD)
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_times_are_read(spark, style, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(x,) for x in GOOD[style]], "t string")
        found = df.select("t", *(c.alias(n) for c, n in zip(parsed_time(df.t, style), "vr"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r.t: r.v for r in found} == GOOD[style]
    assert {r.r for r in found} == {None}


@pytest.mark.parametrize("style", BAD)
def test_others_have_a_reason(spark, style):
    df = spark.createDataFrame([(x,) for x in BAD[style]], "t string")
    found = df.select("t", *(c.alias(n) for c, n in zip(parsed_time(df.t, style), "vr"))).collect()
    assert {r.t: r.r for r in found} == BAD[style]
    assert {r.v for r in found} == {None}


def test_no_such_style(spark):
    with pytest.raises(ValueError, match="no style"):
        parsed_time(spark.range(1).id.cast("string"), "us")


def test_every_row_is_kept_or_set_aside(spark):
    df = spark.createDataFrame(
        [(1, "1996-06-01 10:00", "01/01/1970"), (2, "x", "01/01/1970"), (3, None, None), (4, "x", "40/01/1970")],
        "account_id long, load_ts string, birth_date string",
    )
    parsed = parse_times(df, "portfolio", {"birth_date": "day_first"})
    assert rows(parsed.rows) == [(1, datetime(1996, 6, 1, 10), date(1970, 1, 1)), (3, None, None)]
    assert rows(parsed.rejected, "account_id", "rejected") == [
        (2, ["load_ts: form"]), (4, ["load_ts: form", "birth_date: value"]),
    ]
    assert rows(rejected_counts(parsed.rejected)) == [("birth_date: value", 1), ("load_ts: form", 2)]


def test_times_stay_as_they_are(spark, random_tables):
    parsed = parse_times(random_tables.payments, "payments")
    assert parsed.rows.schema == random_tables.payments.schema
    assert parsed.rejected.count() == 0


def test_read_tables_sets_rows_aside(spark, tmp_path):
    spark.createDataFrame(
        [(10, "02/06/1996 08:00", 1), (20, "2.6.96", 2)], "account_id long, loaded string, past_due int"
    ).write.parquet(str(tmp_path / "portfolio"))
    spark.createDataFrame(
        [(1, "1996-06-01", "x")], "customer_id long, load_ts string, channel string"
    ).write.parquet(str(tmp_path / "third_party"))
    tables = read_tables(
        spark,
        {n: str(tmp_path / n) for n in ("portfolio", "third_party")},
        {"portfolio": {"loaded": "load_ts"}},
        time_styles={"portfolio": "day_first", "third_party": "iso"},
    )
    assert rows(tables.portfolio, "account_id", "load_ts") == [(10, datetime(1996, 6, 2, 8))]
    assert rows(tables.rejected["portfolio"], "account_id", "load_ts") == [(20, "2.6.96")]
    assert tables.rejected["third_party"].count() == 0
    assert tables.third_party.schema["load_ts"].dataType.typeName() == "timestamp_ntz"


def test_a_text_is_parsed_once_however_often_its_time_is_used(spark):
    """Filters on the time were pushed below the parsing, each with its own copy of it."""
    df = spark.range(3).selectExpr("id AS account_id", "concat('1996-06-0', id + 1) AS load_ts", "id AS past_due")
    found = parse_times(df, "portfolio").rows.where(
        "load_ts >= timestamp_ntz'1996-06-02' AND to_date(load_ts) < date'1996-07-01'"
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and ("RLIKE" in x or "regexp" in x)]
    assert "regexp_extract" not in plan
    assert rows(found, "account_id") == [(1,), (2,)]


def test_a_line_end_after_the_time_does_not_matter(spark):
    texts = ["1996-06-01\n", "1996-06-01 09:05\r\n", "1996-06-01 09:05:59.5 ", "1996-06-01\n\n"]
    df = spark.createDataFrame([(x,) for x in texts], "load_ts string")
    parsed = parse_times(df, "portfolio")
    assert rows(parsed.rows) == [
        (datetime(1996, 6, 1),), (datetime(1996, 6, 1, 9, 5),), (datetime(1996, 6, 1, 9, 5, 59, 500000),)
    ]
    assert rows(parsed.rejected, "load_ts") == [("1996-06-01\n\n",)]


def test_faults_are_counted_from_one_parsing(spark):
    """The filter on the rejected rows held a second copy of all the parsing."""
    df = spark.range(4).selectExpr("id AS account_id", "concat('1996-06-3', id) AS load_ts")
    rejected = parse_times(df, "portfolio").rejected
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "RLIKE" in x]
    assert rows(rejected_counts(rejected)) == [("load_ts: value", 3)]


def test_a_pattern_is_matched_once_a_text(spark):
    """The reason, the check of the time and the time each matched the pattern again, and a
    lambda over the faults kept all of it from being compiled."""
    df = spark.range(4).selectExpr(
        "id AS account_id", "concat('1996-06-3', id) AS load_ts", "if(id = 1, 'x', NULL) AS birth_date"
    )
    parsed = parse_times(df, "portfolio")
    for found in (parsed.rows, parsed.rejected):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == 2 and plan.count("try_cast") == 2
        assert "lambda" not in plan
    assert rows(parsed.rejected, "account_id", "rejected") == [
        (1, ["load_ts: value", "birth_date: form"]), (2, ["load_ts: value"]), (3, ["load_ts: value"])
    ]
