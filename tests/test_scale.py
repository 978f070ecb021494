"""Storage layouts and hot keys."""

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

import arrearly as a
from arrearly.operators import scores
from arrearly.operators.portfolio import third_party_exclusions
from arrearly.sources.tables import prune_months
from catalog.fixtures import MONTH, WHOLE
from support import rows


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    names = []

    def set_all(**options):
        for name, value in options.items():
            name = "spark.sql." + name.replace("__", ".")
            names.append(name)
            spark.conf.set(name, value)

    yield set_all
    for name in names:
        spark.conf.unset(name)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["date", "string"])
def test_month_partitions_are_pruned(spark, make_tables, tmp_path, conf, kind):
    conf(maxMetadataStringLength="10000")
    tables = make_tables(1)
    month = F.trunc(F.to_date("load_ts"), "month")
    if kind == "string":
        month = F.date_format("load_ts", "yyyy-MM")
    path = str(tmp_path / "portfolio")
    tables.portfolio.withColumn("part", month).where("part IS NOT NULL").write.partitionBy(
        "part"
    ).parquet(path)
    schema = tables.portfolio.schema.add("part", kind)
    df = spark.read.schema(schema).parquet(path)
    pruned = prune_months(df, "part", MONTH)
    assert re.search(r"PartitionFilters: \[[^\]]*part", physical(pruned))
    found = {r.m for r in pruned.select(F.month("load_ts").alias("m")).distinct().collect()}
    assert found == {6}
    later = a.DayWindow(date(1996, 7, 1), date(1996, 7, 31))
    assert prune_months(df, "part", later).count() == df.where("month(load_ts) = 7").count()


def test_read_tables_prunes(spark, make_tables, tmp_path):
    tables = make_tables(1)
    locations = {}
    stamps = {"portfolio": "load_ts", "third_party": "load_ts", "payments": "payment_ts"}
    for table, ts in stamps.items():
        locations[table] = str(tmp_path / table)
        getattr(tables, table).withColumn(
            "part", F.date_format(ts, "yyyy-MM")
        ).write.partitionBy("part").parquet(locations[table])
    narrow = WHOLE.during(MONTH)
    read = a.read_tables(
        spark, locations, month_columns={"payments": "part", "portfolio": "part"}, settings=narrow
    )
    assert "part" not in read.payments.columns
    assert 0 < read.payments.count() < tables.payments.count()
    assert read.third_party.count() == tables.third_party.count()
    a.demographic_efficiency(read, narrow)
    with pytest.raises(ValueError, match="partitions were read for"):
        a.demographic_efficiency(read, WHOLE)
    with pytest.raises(ValueError, match="shorter lag"):
        a.demographic_efficiency(read, replace(narrow, score_lag_months=1))


def test_scores_and_exposure_are_pruned_by_their_own_days(spark, make_tables, tmp_path):
    """Lagged scores lie before the window, and exposure on its own day."""
    tables = make_tables(1)
    locations = {}
    stamps = {
        "portfolio": "load_ts", "third_party": "load_ts", "scores": "cutoff_date",
        "exposure": "snapshot_date",
    }
    for table, ts in stamps.items():
        locations[table] = str(tmp_path / table)
        getattr(tables, table).withColumn("part", F.date_format(ts, "yyyy-MM")).where(
            "part IS NOT NULL"
        ).write.partitionBy("part").parquet(locations[table])
    for lag in (0, 1, 2):
        settings = replace(WHOLE.during(MONTH), score_lag_months=lag)
        read = a.read_tables(
            spark, locations, month_columns=dict.fromkeys(locations, "part"), settings=settings
        )
        for frames in (read, tables):
            assert rows(scores.scores_by_month(frames.scores, MONTH, lag)) == rows(
                scores.scores_by_month(tables.scores, MONTH, lag)
            )
        day = settings.exposure_date
        assert read.exposure.where(F.col("snapshot_date") == F.lit(day)).count() == (
            tables.exposure.where(F.col("snapshot_date") == F.lit(day)).count()
        )


def test_what_is_missing_is_an_error(make_tables):
    tables = make_tables(1)
    with pytest.raises(ValueError, match="exposure_date"):
        a.monthly_funnel(tables, replace(WHOLE, exposure_date=None))
    with pytest.raises(ValueError, match="after the month"):
        scores.scores_by_month(tables.scores, MONTH, -1)
    assert WHOLE.during(MONTH).exposure_date == date(1996, 5, 31)


def test_bucketed_tables_are_not_shuffled_again(spark, make_tables, conf):
    """With payments, scores and exclusions bucketed by customer, only the
    portfolio and the result are shuffled, once joins may use a part of their
    keys. Customers are then counted without a shuffle, too."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__enabled="false",
        requireAllClusterKeysForCoPartition="false",
    )
    tables = make_tables(1)
    names = ("third_party", "scores", "payments")
    try:
        for name in names:
            getattr(tables, name).write.bucketBy(4, "customer_id").saveAsTable(f"b_{name}")
        bucketed = a.Tables(
            portfolio=tables.portfolio, **{n: spark.table(f"b_{n}") for n in names}
        )
        plain = a.consolidated_efficiency(tables, WHOLE)
        kept = a.consolidated_efficiency(bucketed, WHOLE)
        shuffles = [len(re.findall(r"Exchange ", physical(df))) for df in (plain, kept)]
        assert shuffles == [9, 4]
        assert rows(kept) == rows(plain)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS b_{name}")


def test_hot_account_is_limited_before_the_shuffle(spark):
    """Each map task sends at most one row per account and month."""
    loads = spark.range(0, 200_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 71).otherwise(F.col("id")).alias("account_id"),
        F.col("id").alias("load_id"),
        F.expr("timestamp_ntz'1996-06-01' + make_dt_interval(int(id % 28))").alias("load_ts"),
        F.lit(0).alias("past_due"),
        F.lit(1).cast("decimal(12,2)").alias("balance"),
    )
    from arrearly.operators.portfolio import first_of_month_snapshot

    plan = physical(first_of_month_snapshot(loads, MONTH))
    partial = plan.index("row_number(), 1, Partial") if "row_number(), 1, Partial" in plan else -1
    shuffle = plan.index("Exchange hashpartitioning(account_id")
    assert 0 < shuffle < partial      # plans print from the top down
    got = first_of_month_snapshot(loads, MONTH).where("account_id = 71")
    assert rows(got, "load_id") == [(0,)]


def test_hot_exclusion_is_reduced_before_the_shuffle(make_tables):
    tables = make_tables(2, True)
    plan = physical(third_party_exclusions(tables.third_party, WHOLE.channels, WHOLE.window))
    assert plan.count("HashAggregate") == 2


def test_hot_scores_are_split(spark, conf):
    """Adaptive execution splits a customer-month with a third of the scores."""
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__enabled="true",
        adaptive__advisoryPartitionSizeInBytes="16KB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )
    n = 60_000
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    monthly = spark.range(0, n, 1, 8).select(
        hot.alias("customer_id"),
        F.lit(date(1996, 6, 30)).alias("cutoff_date"),
        F.col("id").cast("int").alias("payment_rank"),
    )
    monthly = scores.scores_by_month(monthly, MONTH)
    accounts = spark.range(0, n, 1, 4).select(
        F.col("id").alias("account_id"),
        (F.col("id") % 50_000).alias("customer_id"),
        F.lit(date(1996, 6, 1)).alias("month"),
    )
    attached = scores.score_attach(accounts, monthly)
    outer = accounts.join(monthly, ["customer_id", "month"], "left")
    found = attached.groupBy().agg(F.count("*"), F.sum("payment_rank"))
    found_row = found.collect()
    assert "skew=true" in physical(found)
    assert found_row == outer.groupBy().agg(F.count("*"), F.sum("payment_rank")).collect()
