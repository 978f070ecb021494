from datetime import date, datetime
from decimal import Decimal

from support import rows
from pyspark.sql import functions as F

from arrearly import DayWindow
from arrearly.operators.portfolio import (
    exclude_third_party,
    first_of_month_snapshot,
    third_party_exclusions,
)

JUNE = DayWindow(date(2026, 6, 1), date(2026, 6, 30))


def load(account, load_id, day, balance=1, hour=0, **more):
    return dict(
        account_id=account,
        load_id=load_id,
        load_ts=datetime(2026, *day, hour),
        balance=None if balance is None else Decimal(balance),
        past_due=0,
        **more,
    )


def test_first_qualifying_load(frame):
    portfolio = frame(
        "portfolio",
        load(11, 1, (5, 31)),             # before the window
        load(11, 2, (6, 2), balance=0),   # no balance
        load(11, 3, (6, 4)),
        load(11, 4, (6, 5)),
        load(12, 5, (6, 30), hour=23),    # intraday on the last day
        load(0, 6, (6, 1)),
        load(None, 7, (6, 1)),
        load(-5, 8, (6, 1)),
        load(21, 9, (6, 3), balance=None),
    )
    assert rows(first_of_month_snapshot(portfolio, JUNE), "account_id", "load_id") == [
        (11, 3), (12, 5),
    ]
    assert rows(
        first_of_month_snapshot(portfolio, JUNE, require_balance=False), "account_id", "load_id"
    ) == [(11, 2), (12, 5), (21, 9)]


def test_same_day_ties_go_to_the_lowest_load(frame):
    # The earlier hour does not win: loads are ranked by day.
    portfolio = frame("portfolio", load(11, 8, (6, 4), hour=1), load(11, 3, (6, 4), hour=9))
    assert rows(first_of_month_snapshot(portfolio, JUNE), "load_id") == [(3,)]


def test_ties_without_load_id_do_not_depend_on_row_order(frame):
    tied = [load(11, None, (6, 4), balance=b) for b in (5, 3, 9)]
    for order in (tied, tied[::-1]):
        portfolio = frame("portfolio", *order).drop("load_id")
        assert rows(first_of_month_snapshot(portfolio, JUNE), "balance") == [(Decimal(3),)]


def test_ids(frame):
    portfolio = frame("portfolio", load(57, 1, (6, 1)), load(58, 2, (6, 1)))
    assert rows(first_of_month_snapshot(portfolio, JUNE), "customer_id") == [(5,), (5,)]
    assert rows(first_of_month_snapshot(portfolio, JUNE, strip=False), "customer_id") == [
        (57,), (58,),
    ]


def test_one_row_per_account_and_month(random_tables):
    window = DayWindow(date(1996, 5, 1), date(1996, 6, 30))
    snapshot = first_of_month_snapshot(random_tables.portfolio, window)
    per_key = snapshot.groupBy("account_id", "month").count()
    assert per_key.where("count > 1").count() == 0
    assert per_key.count() > 20


def test_exclusion_list(frame):
    third_party = frame(
        "third_party",
        dict(customer_id=1, load_ts=datetime(2026, 6, 3), channel="V1"),
        dict(customer_id=1, load_ts=datetime(2026, 6, 9), channel="V2"),
        dict(customer_id=2, load_ts=datetime(2026, 6, 3), channel="X"),
        dict(customer_id=3, load_ts=datetime(2026, 6, 30, 10), channel="V1"),
        dict(customer_id=4, load_ts=datetime(2026, 6, 30), channel="V1"),
    )
    june = date(2026, 6, 1)
    assert rows(third_party_exclusions(third_party, ["V1", "V2"], JUNE)) == [(1, june), (4, june)]
    whole = third_party_exclusions(third_party, ["V1", "V2"], JUNE, whole_last_day=True)
    assert rows(whole, "customer_id") == [(1,), (3,), (4,)]
    assert rows(third_party_exclusions(third_party, ["V1"], JUNE, monthly=False)) == [(1,), (4,)]


def test_exclusion_equals_outer_join(spark):
    a = spark.createDataFrame(
        [(1, "m"), (1, "n"), (2, "m"), (None, "m")], "customer_id bigint, month string"
    )
    e = spark.createDataFrame([(1, "m"), (None, "m")], "customer_id bigint, month string")
    outer = (
        a.join(e.withColumn("hit", F.lit(1)), ["customer_id", "month"], "left")
        .where("hit IS NULL")
        .drop("hit")
    )
    assert rows(exclude_third_party(a, e)) == rows(outer) == [(1, "n"), (2, "m"), (None, "m")]
