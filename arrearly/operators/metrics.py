"""Segment metrics: efficiency meshes, month pivots, the funnel and its rates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearly.functions.bands import amount_due
from arrearly.functions.rounding import percent


def efficiency_mesh(
    mesh: DataFrame,
    dims: Sequence[str | Column],
    *measures: Column,
    balance: Column | str = "balance",
    recovered: Column | str = "recovered_amount",
    efficiency: str = "real_efficiency_pct",
) -> DataFrame:
    """``measures``, total balance, total recovery and efficiency % per segment.

    ``mesh`` has one row per account or per account and payment day; whichever
    it is, the balance of every row counts.
    """
    return (
        mesh.groupBy(*dims)
        .agg(
            *measures,
            F.sum(balance).alias("total_assigned_balance"),
            F.sum(recovered).alias("total_recovered_amount"),
        )
        .withColumn(
            efficiency,
            percent(F.col("total_recovered_amount"), F.col("total_assigned_balance")),
        )
    )


def month_pivot(
    df: DataFrame,
    row: str,
    months: Sequence[str],
    value: Column | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` by the given 'YYYY-MM' months, in that order, empty cells 0.

    The months are given, so no job runs to find them, and Spark aggregates by
    (row, month) before it spreads the few results over columns.
    """
    value = F.count(F.lit(1)) if value is None else value
    labels = list(labels or months)
    wide = df.groupBy(row).pivot("month_year", list(months)).agg(value)
    return wide.select(
        row,
        *[
            F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(label)
            for m, label in zip(months, labels)
        ],
    )


def exposure_due(exposure: DataFrame, on: date) -> DataFrame:
    """Amount due per exposure row of one snapshot day."""
    return exposure.where(F.col("snapshot_date") == F.lit(on)).withColumn(
        "amount_due", amount_due("overdue_balance", "base_fee", "current_balance")
    )


def customer_due(due: DataFrame) -> DataFrame:
    return due.groupBy("customer_id").agg(F.sum("amount_due").alias("amount_due"))


def collection_funnel(
    accounts: DataFrame,
    calls: DataFrame,
    payment_days: DataFrame,
    due: DataFrame,
    net: bool = False,
) -> DataFrame:
    """Customers per bucket at each stage, and the total amount due.

    ``calls``, ``payment_days`` and ``due`` hold one row per customer, so the
    joins are one to one. The published sum of the amount due runs over the
    join of calls, payment days and exposure, i.e. it counts an amount once per
    call and payment day; that product is kept as a factor. ``net=True`` counts
    each amount once.
    """
    once = F.lit(1).cast("decimal(13,0)")
    times = (
        F.greatest(F.coalesce(F.col("n_calls"), F.lit(1)), F.lit(1))
        * F.greatest(F.coalesce(F.col("n_payment_days"), F.lit(1)), F.lit(1))
    ).cast("decimal(13,0)")
    paid = F.col("last_payment_date") >= F.col("record_date")
    per_customer = (
        accounts.select("customer_id", "risk_bucket", "record_date")
        .join(calls, "customer_id", "left")
        .join(payment_days, "customer_id", "left")
        .join(due, "customer_id", "left")
        .groupBy("customer_id", "risk_bucket")
        .agg(
            F.max("dialed").alias("dialed"),
            F.max("rpc").alias("rpc"),
            F.max("agreed").alias("agreed"),
            F.max(paid).alias("paid"),
            F.sum(F.col("amount_due") * (once if net else times)).alias("amount_due"),
        )
    )
    return per_customer.groupBy("risk_bucket").agg(
        F.count(F.lit(1)).alias("assigned_customers"),
        F.count_if("dialed").alias("dialed_customers"),
        F.count_if("rpc").alias("rpc_customers"),
        F.count_if("agreed").alias("agreement_customers"),
        F.count_if("paid").alias("paying_customers"),
        F.sum("amount_due").alias("total_amount_due"),
    )


def kpi_rates(counts: DataFrame) -> DataFrame:
    """Contact and conversion rates of funnel counts.

    The denominators are a choice of this library: contacted customers over
    assigned ones, customers with an agreement over contacted ones.
    """
    return counts.withColumns(
        {
            "rpc_contact_rate_pct": percent(
                F.col("rpc_customers"), F.col("assigned_customers")
            ),
            "agreement_conversion_rate_pct": percent(
                F.col("agreement_customers"), F.col("rpc_customers")
            ),
        }
    )


def customer_kpis(accounts: DataFrame) -> DataFrame:
    """One row per customer, month and bucket: contacted, agreeing, recovery.

    ``accounts`` has one row per account, with the call counts and the net recovery: a
    customer's payments of a month count once, in the bucket of its first account.
    """
    return accounts.groupBy("customer_id", "month", "risk_bucket").agg(
        F.max(F.col("total_contacts") > 0).alias("rpc"),
        F.max(F.col("total_agreements") > 0).alias("agreed"),
        F.sum("recovered_amount").alias("recovered_amount"),
    )


def monthly_kpis(accounts: DataFrame) -> DataFrame:
    """Assigned, contacted and agreeing customers and realized recovery per month
    and bucket, with the rates, from the accounts of ``customer_kpis``."""
    return kpi_rates(
        customer_kpis(accounts)
        .groupBy("month", "risk_bucket")
        .agg(
            F.count(F.lit(1)).alias("assigned_customers"),
            F.count_if("rpc").alias("rpc_customers"),
            F.count_if("agreed").alias("agreement_customers"),
            F.sum("recovered_amount").alias("realized_recovery"),
        )
    )


def kpi_pivot(kpis: DataFrame, months: Sequence[str]) -> DataFrame:
    """``monthly_kpis`` with a row per bucket and KPI and a column per month.

    A bucket without customers in a month has NULL there: it has no rate.
    """
    names = [
        "assigned_customers",
        "rpc_contact_rate_pct",
        "agreement_conversion_rate_pct",
        "realized_recovery",
    ]
    return (
        kpis.select(
            "month_year",
            "risk_bucket",
            *[F.col(n).cast("decimal(38,2)").alias(n) for n in names],
        )
        .unpivot(["month_year", "risk_bucket"], names, "kpi", "value")
        .groupBy("risk_bucket", "kpi")
        .pivot("month_year", list(months))
        .agg(F.max("value"))
    )
