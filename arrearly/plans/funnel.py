"""One-month collection funnel and the monthly executive KPIs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.operators.activity import (
    attach_contact,
    contact_activity,
    customer_calls,
    promise_calls,
)
from arrearly.operators.metrics import (
    collection_funnel,
    customer_due,
    exposure_due,
    kpi_pivot,
    monthly_kpis,
)
from arrearly.operators.payments import customer_payment_days, daily_payments, net_recovery
from arrearly.operators.portfolio import managed_accounts, with_month_year
from arrearly.params import CORE, STAGING, Settings, rolling_months
from arrearly.sources.tables import Tables


def funnel_counts(
    tables: Tables, settings: Settings = CORE, net: bool = False
) -> DataFrame:
    """Funnel stages per bucket. All sources share one id space, so no id is
    stripped, and the exclusion holds for the whole window."""
    if settings.exposure_date is None:
        raise ValueError("the funnel needs an exposure_date: the day of the amounts due")
    tables.check(settings)
    accounts = managed_accounts(
        tables.portfolio, tables.third_party, settings, monthly=False, strip=False,
        used=("past_due", "balance"),
    )
    calls = customer_calls(
        promise_calls(tables.interactions, settings.phone_kind, settings.window),
        settings.rpc_codes,
        settings.agreement_codes,
        settings.system_code,
    )
    days = customer_payment_days(
        daily_payments(
            tables.payments, settings.payment_kind, settings.window, settings.whole_last_day
        )
    )
    due = customer_due(exposure_due(tables.exposure, settings.exposure_date))
    return collection_funnel(accounts, calls, days, due, net)


def monthly_funnel(
    tables: Tables, settings: Settings = CORE, net: bool = False
) -> DataFrame:
    """P05: assigned, dialled, contacted, agreeing and paying customers by bucket."""
    return (
        funnel_counts(tables, settings, net)
        .select(
            F.col("risk_bucket").alias("mora_bucket"),
            F.col("assigned_customers").alias("total_cartera_asignada"),
            F.col("dialed_customers").alias("clientes_llamada_enlazada"),
            F.col("rpc_customers").alias("clientes_contacto_efectivo"),
            F.col("agreement_customers").alias("clientes_con_convenio"),
            F.col("paying_customers").alias("clientes_pagadores"),
            F.col("total_amount_due").alias("exigible_total_monto"),
        )
        .orderBy(F.asc_nulls_last("mora_bucket"))
    )


def kpis_by_month(tables: Tables, settings: Settings = STAGING) -> DataFrame:
    """Assigned customers, contact rate, agreement rate and realized recovery by
    month and bucket."""
    return _kpis(tables, settings).orderBy(
        F.asc_nulls_last("month_year"), F.asc_nulls_last("risk_bucket")
    )


def _kpis(tables: Tables, settings: Settings) -> DataFrame:
    return monthly_kpis(kpi_accounts(tables, settings)).transform(with_month_year).drop("month")


def kpi_accounts(tables: Tables, settings: Settings) -> DataFrame:
    """Managed accounts with the calls of their customer's month and the net recovery."""
    tables.check(settings)
    accounts = managed_accounts(
        tables.portfolio, tables.third_party, settings, used=("past_due", "balance")
    ).select("account_id", "customer_id", "month", "record_date", "risk_bucket")
    activity = contact_activity(
        tables.interactions,
        settings.phone_kind,
        settings.rpc_codes,
        settings.agreement_codes,
        settings.window,
    )
    daily = daily_payments(
        tables.payments, settings.payment_kind, settings.window, settings.whole_last_day
    )
    return net_recovery(attach_contact(accounts, activity), daily)


def rolling_kpis(
    tables: Tables, end: date, n: int = 12, settings: Settings = STAGING
) -> DataFrame:
    """The KPIs of the ``n`` months that end with the month of ``end``, one row per
    bucket and KPI."""
    window = rolling_months(end, n)
    return kpi_pivot(
        _kpis(tables, settings.during(window)), window.month_keys()
    ).orderBy(F.asc_nulls_last("risk_bucket"), "kpi")
