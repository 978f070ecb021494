"""Month states: what later reports need of a month, kept so that months can be put together.

A state has the recovery and, as exact bitmaps, the customers that were assigned, contacted
and agreeing, per month and bucket. Sums add up and bitmaps are or-ed, so any span of
months follows from its states: a new month is added without reading the others, and
customers are counted once over a whole span, which sums of monthly counts can not do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearly.functions.calendar import month_key
from arrearly.operators.metrics import customer_kpis, kpi_pivot, kpi_rates
from arrearly.params import STAGING, DayWindow, Settings, rolling_months
from arrearly.plans.funnel import kpi_accounts
from arrearly.sources.tables import Tables

STAGES = ("assigned", "rpc", "agreed")
COUNTS = dict(zip(STAGES, ("assigned_customers", "rpc_customers", "agreement_customers")))


def customer_sets(
    df: DataFrame, keys: Sequence[str | Column], stages: Mapping[str, Column], customer: str = "customer_id"
) -> DataFrame:
    """Per ``keys`` and range of 32,768 ids (``part``), a bitmap of the customers for whom
    each of ``stages`` holds.

    A bitmap takes 4 KB whatever is set in it: made for ids that lie densely, as account
    systems number them. Spark sorts by key and range, so a task holds one bitmap per stage.
    Ids that are NULL are in no set.
    """
    place = F.bitmap_bit_position(F.col(customer))
    return (
        df.where(F.col(customer).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(F.col(customer)).alias("part"))
        .agg(*(F.bitmap_construct_agg(F.when(c, place)).alias(n) for n, c in stages.items()))
    )


def set_sizes(sets: DataFrame, keys: Sequence[str], stages: Mapping[str, str]) -> DataFrame:
    """Distinct customers per ``keys``, over all rows of ``sets`` with these keys.

    ``stages`` maps the bitmaps to names of counts.
    """
    united = sets.groupBy(*keys, "part").agg(*(F.bitmap_or_agg(s).alias(s) for s in stages))
    return united.groupBy(*keys).agg(
        *(F.sum(F.bitmap_count(s)).alias(n) for s, n in stages.items())
    )


def kpi_states(tables: Tables, settings: Settings = STAGING) -> DataFrame:
    """The states of the months of ``settings``: month_year, risk_bucket, part, a bitmap per
    stage, and the recovery of the customers of the part.

    As published, a window leaves out the intraday rows of its last day, so a month has
    another state in the middle of a window than at its end. States that are to be put
    together need ``whole_last_day=True``, all but that of the window's last month.
    """
    customers = customer_kpis(kpi_accounts(tables, settings)).withColumn("month_year", month_key("month"))
    keys = ["month_year", "risk_bucket"]
    stages = {"assigned": F.lit(True), "rpc": F.col("rpc"), "agreed": F.col("agreed")}
    recovery = customers.groupBy(
        *keys, F.bitmap_bucket_number(F.col("customer_id")).alias("part")
    ).agg(F.sum("recovered_amount").alias("realized_recovery"))
    return customer_sets(customers, keys, stages).join(recovery, [*keys, "part"])


def write_states(states: DataFrame, path: str) -> None:
    """Add states to the table at ``path``; those of a month take the place of older ones."""
    (
        states.repartitionByRange("month_year", "risk_bucket", "part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month_year")
        .parquet(path)
    )


def read_states(spark: SparkSession, path: str, window: DayWindow) -> DataFrame:
    """The states of the months of ``window``; other months are not opened."""
    months = window.month_keys()
    states = spark.read.parquet(path)
    return states.where(F.col("month_year").cast("string").between(months[0], months[-1])).withColumn(
        "month_year", F.col("month_year").cast("string")
    )


def kpis_from_states(states: DataFrame) -> DataFrame:
    """``kpis_by_month`` without its order: counts, recovery and rates by month and bucket."""
    return _kpis_by(states, ["month_year", "risk_bucket"])


def span_kpis(states: DataFrame) -> DataFrame:
    """The same over the whole span, by bucket: a customer counts once, however many of
    the months it was assigned, contacted or agreeing in."""
    return _kpis_by(states, ["risk_bucket"])


def _kpis_by(states: DataFrame, keys: list[str]) -> DataFrame:
    recovery = states.groupBy(*keys).agg(F.sum("realized_recovery").alias("realized_recovery"))
    return kpi_rates(set_sizes(states, keys, COUNTS).join(recovery, keys))


def rolling_kpis_from_states(
    spark: SparkSession, path: str, end: date, n: int = 12
) -> DataFrame:
    """``rolling_kpis`` of the ``n`` months that end with the month of ``end``, from states."""
    window = rolling_months(end, n)
    kpis = kpis_from_states(read_states(spark, path, window))
    return kpi_pivot(kpis, window.month_keys()).orderBy(F.asc_nulls_last("risk_bucket"), "kpi")
