"""Bucket by month tables: assigned accounts, covered customers, agreements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.operators.activity import agreements, contacted_customers
from arrearly.operators.keys import CUSTOMER_MONTH
from arrearly.operators.metrics import month_pivot
from arrearly.operators.portfolio import managed_accounts, with_month_year
from arrearly.params import DIRECTORY, STAGING, Settings, spanish_month_label
from arrearly.sources.tables import Tables


def assigned_by_month(
    tables: Tables, settings: Settings = STAGING, strip: bool = False
) -> DataFrame:
    """P01a: assigned accounts, bucket x month, also those without a balance.

    As published the account id, check digit included, is compared with the
    excluded customer ids; ``strip=True`` compares customers with customers.
    """
    tables.check(settings)
    accounts = managed_accounts(
        tables.portfolio,
        tables.third_party,
        settings,
        require_balance=False,
        used=("past_due",),
        exclusion_id="customer_id" if strip else "account_id",
    )
    return month_pivot(
        with_month_year(accounts), "risk_bucket", settings.window.month_keys()
    ).orderBy(F.asc_nulls_last("risk_bucket"))


def covered_customers(tables: Tables, settings: Settings = STAGING) -> DataFrame:
    """P01b: customers with a telephone event in the month, by month and bucket."""
    tables.check(settings)
    accounts = managed_accounts(
        tables.portfolio, tables.third_party, settings, used=("past_due", "balance")
    )
    contacted = contacted_customers(
        tables.interactions, settings.phone_kind, settings.window
    )
    # The rows are still partitioned by customer and month, so one row per
    # customer needs no shuffle, and then a plain count does.
    return (
        accounts.join(contacted, CUSTOMER_MONTH, "left_semi")
        .select(*CUSTOMER_MONTH, "risk_bucket")
        .distinct()
        .groupBy("month", "risk_bucket")
        .agg(F.count("customer_id").alias("covered_customers"))
        .transform(with_month_year)
        .select("month_year", "risk_bucket", "covered_customers")
        .orderBy(F.asc_nulls_last("month_year"), F.asc_nulls_last("risk_bucket"))
    )


def agreements_by_month(tables: Tables, settings: Settings = DIRECTORY) -> DataFrame:
    """P06: customers with an agreement, bucket x month. A bucket without any
    agreement has no row."""
    tables.check(settings)
    accounts = managed_accounts(
        tables.portfolio, tables.third_party, settings, used=("past_due", "balance")
    )
    agreed = agreements(
        tables.interactions, settings.phone_kind, settings.agreement_codes, settings.window
    )
    customers = (
        accounts.join(agreed, CUSTOMER_MONTH, "left_semi")
        .select(*CUSTOMER_MONTH, "risk_bucket")
        .distinct()
    )
    months = settings.window.month_keys()
    return (
        month_pivot(
            with_month_year(customers),
            "risk_bucket",
            months,
            labels=[spanish_month_label(m) for m in months],
        )
        .withColumnRenamed("risk_bucket", "bucket_mora")
        .orderBy(F.asc_nulls_last("bucket_mora"))
    )
