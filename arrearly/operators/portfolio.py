"""Monthly portfolio snapshot and the exclusion of externally managed customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrearly.functions.bands import risk_bucket, strip_check_digit
from arrearly.functions.calendar import day, month_key, month_start
from arrearly.params import DayWindow, Settings


def first_of_month_snapshot(
    portfolio: DataFrame,
    window: DayWindow,
    require_balance: bool = True,
    strip: bool = True,
    tie_breakers: Sequence[str] | None = None,
) -> DataFrame:
    """First qualifying load of each account in each calendar month.

    The filters run before the ranking: a load outside the window or without a
    balance can not be the first one. Loads of the same day are ordered by
    ``tie_breakers`` (default: ``load_id``, else every other column), so the
    choice does not depend on row order. A caller that uses few columns passes
    those: a tie on all of them can not change its result, and no other column
    is read.

    ``rn = 1`` directly above the ranking lets Spark limit each group to one
    row in every map task, so an account with very many loads sends at most one
    row per month and task through the shuffle.

    Adds ``record_date``, ``month`` (its first day), ``risk_bucket`` and
    ``customer_id``: the account id without its check digit, or as it is for
    sources with a single id space (``strip=False``). An account has one digit,
    so a customer has at most ten rows per month.
    """
    qualified = (F.col("account_id") > 0) & window.by_day("load_ts")
    if require_balance:
        qualified &= F.col("balance") > 0
    if tie_breakers is None:
        tie_breakers = (
            ["load_id"]
            if "load_id" in portfolio.columns
            else sorted(set(portfolio.columns) - {"account_id"})
        )
    first = Window.partitionBy("account_id", "month").orderBy("record_date", *tie_breakers)
    return (
        portfolio.where(qualified)
        .withColumns({"record_date": day("load_ts"), "month": month_start("load_ts")})
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .drop("rn")
        .withColumns(
            {
                "customer_id": strip_check_digit("account_id")
                if strip
                else F.col("account_id"),
                "risk_bucket": risk_bucket("past_due"),
            }
        )
        # Neither is ever NULL here. Stated, because an inner join adds these
        # filters and an outer or anti-join does not, and only equal plans are
        # computed once when a query uses the snapshot twice.
        .where("customer_id IS NOT NULL AND month IS NOT NULL")
    )


def with_month_year(df: DataFrame) -> DataFrame:
    return df.withColumn("month_year", month_key("month"))


def third_party_exclusions(
    third_party: DataFrame,
    channels: Sequence[str],
    window: DayWindow,
    monthly: bool = True,
    whole_last_day: bool = False,
) -> DataFrame:
    """Distinct customers (and months) assigned to one of ``channels``.

    DISTINCT stays although an anti-join would not need it: it runs in the map
    tasks first, so a customer with very many assignments is one row per task.
    """
    handed_over = third_party.where(
        F.col("channel").isin(*channels) & window.contains("load_ts", whole_last_day)
    )
    if monthly:
        return handed_over.select("customer_id", month_start("load_ts").alias("month")).distinct()
    return handed_over.select("customer_id").distinct()


def exclude_third_party(
    accounts: DataFrame, exclusions: DataFrame, id_column: str = "customer_id"
) -> DataFrame:
    """Accounts whose customer (in that month, for a monthly list) is not excluded."""
    keys = [id_column] + [c for c in exclusions.columns if c == "month"]
    return accounts.join(
        exclusions.withColumnRenamed("customer_id", id_column), keys, "left_anti"
    )


def managed_accounts(
    portfolio: DataFrame,
    third_party: DataFrame,
    settings: Settings,
    monthly: bool = True,
    require_balance: bool = True,
    strip: bool = True,
    exclusion_id: str = "customer_id",
    used: Sequence[str] | None = None,
) -> DataFrame:
    """Snapshot without the externally managed customers: the base of every analysis.

    ``used`` are the columns, beside the key and the load time, that the analysis
    takes from a load. Without a ``load_id`` loads of one day are ordered by them.
    """
    ties = None if used is None or "load_id" in portfolio.columns else list(used)
    snapshot = first_of_month_snapshot(
        portfolio, settings.window, require_balance, strip, ties
    )
    exclusions = third_party_exclusions(
        third_party, settings.channels, settings.window, monthly, settings.whole_last_day
    )
    return exclude_third_party(snapshot, exclusions, exclusion_id)
