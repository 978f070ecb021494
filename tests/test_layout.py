"""Tables stored by month: what is read, and what loading a month again changes."""

import re
from datetime import datetime, timedelta
from decimal import Decimal
from threading import Barrier

import pytest
from pyspark.sql import functions as F
from support import rows

import arrearly as a
from arrearly.sources import layout
from arrearly.sources.layout import MONTH_COLUMN, TIME_COLUMNS, read_months, write_months, write_tables
from arrearly.sources.schemas import SCHEMAS
from catalog.fixtures import FUNNEL, PIVOT, WHOLE, StarTables, single_id

ALL = list(SCHEMAS)


@pytest.fixture(scope="module")
def star(spark):
    return StarTables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def root(star, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months"))
    write_tables(star, path, ALL)
    return path


def months_read(df):
    files = df.select(F.input_file_name().alias("f")).distinct().collect()
    return {re.search(f"{MONTH_COLUMN}=([^/]*)/", r.f)[1] for r in files}


def test_only_the_months_of_the_window_are_read(spark, root):
    stored = read_months(spark, root, FUNNEL, ALL)
    for table in ("portfolio", "third_party", "interactions", "payments"):
        assert months_read(getattr(stored, table)) == {"1996-06"}
    assert months_read(stored.exposure) == {"1996-05"}
    assert months_read(stored.scores) <= {"1996-05", "1996-06"}
    year = read_months(spark, root, PIVOT, ALL)
    assert months_read(year.portfolio) == set(PIVOT.window.month_keys())


def test_the_plan_has_partition_filters(spark, root):
    stored = read_months(spark, root, FUNNEL, ALL)
    plan = a.monthly_funnel(single_id(stored), FUNNEL)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 5
    for line in scans:
        assert f"isnotnull({MONTH_COLUMN}" in re.search(r"PartitionFilters: \[(.*?)\]", line)[1]


@pytest.mark.parametrize(
    ("analysis", "settings"),
    [
        (a.assigned_by_month, PIVOT), (a.covered_customers, PIVOT), (a.score_efficiency, PIVOT),
        (a.demographic_efficiency, PIVOT), (a.consolidated_efficiency, PIVOT),
        (a.monthly_funnel, FUNNEL), (a.agreements_by_month, PIVOT),
        (a.predictive_efficiency, PIVOT), (a.kpis_by_month, PIVOT),
    ],
)
def test_same_results_as_whole_tables(spark, star, root, analysis, settings):
    assert rows(analysis(read_months(spark, root, settings, ALL), settings)) == rows(
        analysis(star, settings)
    )


def test_every_row_is_stored_once(spark, star, root):
    for table in ALL:
        source = getattr(star, table)
        stored = spark.read.parquet(f"{root}/{table}").drop(MONTH_COLUMN)
        assert stored.exceptAll(source).isEmpty() and source.exceptAll(stored).isEmpty()


def test_a_month_is_replaced_and_others_stay(spark, frame, tmp_path):
    def payment(day, amount):
        return dict(customer_id=1, payment_ts=datetime(1996, *day), amount=Decimal(amount), payment_kind="N")

    path = str(tmp_path / "payments")
    write_months(frame("payments", payment((5, 1), 1), payment((6, 1), 2), payment((6, 2), 3)), "payments", path)
    before = set(spark.read.parquet(path).inputFiles())
    again = frame("payments", payment((6, 9), 7), payment((7, 1), 8))
    for _ in range(2):  # a load that is repeated changes nothing
        write_months(again, "payments", path)
        stored = spark.read.parquet(path)
        assert rows(stored, "amount") == [(1,), (7,), (8,)]
    kept = before & set(stored.inputFiles())
    assert len(kept) == 1 and "1996-05" in kept.pop()


def test_rows_without_a_time_are_kept_but_not_read(spark, frame, tmp_path):
    df = frame("scores", dict(customer_id=1), dict(customer_id=2, cutoff_date=datetime(1996, 6, 30).date()))
    write_months(df, "scores", str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    for table in ("portfolio", "third_party"):
        some = dict(load_ts=datetime(1996, 6, 1), customer_id=1, channel="x", account_id=10)
        row = {c: v for c, v in some.items() if c in SCHEMAS[table].names}
        write_months(frame(table, row), table, str(tmp_path / table))
    stored = read_months(spark, str(tmp_path), FUNNEL, ["portfolio", "third_party", "scores"])
    assert rows(stored.scores, "customer_id") == [(2,)]


def test_a_hot_customer_fills_many_tasks(spark, tmp_path):
    """One customer with all rows of one month: the ranges end within its month."""
    start = datetime(1996, 6, 1)
    df = spark.range(20_000).select(
        F.lit(7).cast("long").alias("customer_id"),
        (F.lit(start) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp_ntz").alias("payment_ts"),
        F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.lit("N").alias("payment_kind"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_months(df, "payments", str(tmp_path / "payments"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(str(tmp_path / "payments")).inputFiles()) >= 4
    assert start + timedelta(minutes=20_000) < datetime(1996, 6, 30)


def test_tables_are_written_at_the_same_time(spark, star, tmp_path, monkeypatch):
    """One after the other, each table's last tasks left the other cores idle."""
    both, groups = Barrier(2, timeout=60), []

    def write(df, table, path):
        both.wait()  # passes only when the other table is being written too
        groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        write_months(df, table, path)

    monkeypatch.setattr(layout, "write_months", write)
    spark.sparkContext.setJobGroup("loads", "")
    try:
        write_tables(star, str(tmp_path), ["scores", "third_party"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert groups == ["loads", "loads"]
    for table in ("scores", "third_party"):
        assert spark.read.parquet(f"{tmp_path}/{table}").count() == getattr(star, table).count()


def test_a_table_that_can_not_be_written_is_an_error(star, tmp_path, monkeypatch):
    def write(df, table, path):
        raise OSError(table)

    monkeypatch.setattr(layout, "write_months", write)
    with pytest.raises(OSError, match="scores"):
        write_tables(star, str(tmp_path), ["scores", "third_party"])


def test_a_wider_window_is_refused(spark, root):
    with pytest.raises(ValueError, match="partitions were read"):
        a.assigned_by_month(read_months(spark, root, FUNNEL, ALL), WHOLE)


def test_every_table_has_a_time_column():
    assert all(TIME_COLUMNS[t] in s.names for t, s in SCHEMAS.items())
