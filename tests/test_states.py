"""Month states: exact sets of customers, and months that are added one by one."""

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F
from support import rows

import arrearly as a
from arrearly.params import rolling_months
from arrearly.plans.states import (
    COUNTS,
    customer_sets,
    kpis_from_states,
    read_states,
    set_sizes,
)
from arrearly.sources.layout import read_months, write_tables
from catalog.fixtures import WHOLE, StarTables

END = date(1997, 1, 31)
NAMES = ["portfolio", "third_party", "interactions", "payments"]


@pytest.mark.parametrize("base", [0, 2**63 - 40_000, -(2**63), -20_000, 2**40])
def test_sets_are_exact(spark, base):
    """Ids at both ends of the range, around zero and across ranges of a bitmap."""
    ids = [base + (i * 7919) % 40_000 for i in range(300)] + [base] * 5 + [None]
    df = spark.createDataFrame([(i, n % 3) for n, i in enumerate(ids)], "customer_id long, month int")
    sets = customer_sets(df, ["month"], {"all": F.lit(True), "odd": F.col("customer_id") % 2 != 0})
    got = set_sizes(sets.withColumn("k", F.lit(1)), ["k"], {"all": "n", "odd": "n_odd"}).collect()[0]
    known = set(ids) - {None}
    assert (got.n, got.n_odd) == (len(known), sum(i % 2 for i in known))


def test_states_give_the_monthly_kpis(random_tables):
    states = a.kpi_states(random_tables, WHOLE)
    want = a.kpis_by_month(random_tables, WHOLE)
    assert rows(kpis_from_states(states), *want.columns) == rows(want)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    write_tables(StarTables(spark, "/root/testdata/sf0.001"), root, NAMES)
    return root


def test_a_month_is_added_without_the_others(spark, stored, tmp_path):
    path = str(tmp_path / "states")
    window = rolling_months(END, 12)
    whole = StarTables(spark, "/root/testdata/sf0.001")
    for back in range(12):
        end = date.fromisoformat(window.month_keys()[11 - back] + "-01")
        month = replace(WHOLE.during(rolling_months(end, 1)), whole_last_day=back > 0)
        a.write_states(a.kpi_states(read_months(spark, stored, month, NAMES), month), path)
    assert rows(a.rolling_kpis_from_states(spark, path, END)) == rows(
        a.rolling_kpis(whole, END, settings=WHOLE)
    )
    # The last month reads one month of every table.
    month = WHOLE.during(rolling_months(END, 1))
    for table in NAMES:
        df = getattr(read_months(spark, stored, month, NAMES), table)
        files = df.select(F.input_file_name().alias("f")).distinct().collect()
        assert {re.search("load_month=([^/]*)/", r.f)[1] for r in files} <= {"1997-01"}


def test_a_month_written_again_is_replaced(spark, random_tables, tmp_path):
    path = str(tmp_path / "states")
    states = a.kpi_states(random_tables, WHOLE)
    for _ in range(2):
        a.write_states(states, path)
    kept = read_states(spark, path, WHOLE.window)
    assert rows(kpis_from_states(kept)) == rows(kpis_from_states(states))
    june = read_states(spark, path, rolling_months(date(1996, 6, 1), 1))
    assert {r.month_year for r in june.select("month_year").distinct().collect()} == {"1996-06"}


def test_span_counts_customers_once(random_tables):
    states = a.kpi_states(random_tables, WHOLE)
    monthly = kpis_from_states(states).groupBy("risk_bucket").agg(
        F.max("assigned_customers").alias("most"), F.sum("assigned_customers").alias("sum")
    )
    for r in a.span_kpis(states).join(monthly, "risk_bucket").collect():
        assert r.most <= r.assigned_customers <= r.sum
    assert set(COUNTS.values()) <= set(a.span_kpis(states).columns)
