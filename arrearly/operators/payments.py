"""Payments: daily and monthly sums, and recovery after assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrearly.functions.calendar import day, month_start
from arrearly.operators.keys import CUSTOMER_MONTH
from arrearly.params import DayWindow


def account_payments(
    payments: DataFrame, kind: str, window: DayWindow, whole_last_day: bool = False
) -> DataFrame:
    """Payments of one kind in the window."""
    return payments.where(
        (F.col("payment_kind") == kind) & window.contains("payment_ts", whole_last_day)
    )


def daily_payments(
    payments: DataFrame, kind: str, window: DayWindow, whole_last_day: bool = False
) -> DataFrame:
    """Sum per customer and day: at most 31 rows per customer and month."""
    return (
        account_payments(payments, kind, window, whole_last_day)
        .groupBy("customer_id", day("payment_ts").alias("payment_date"))
        .agg(F.sum("amount").alias("paid_amount"))
        .withColumn("month", month_start("payment_date"))
    )


def monthly_payments(
    payments: DataFrame, kind: str, window: DayWindow, whole_last_day: bool = False
) -> DataFrame:
    """Sum per customer and month, also of days before the assignment."""
    return (
        account_payments(payments, kind, window, whole_last_day)
        .groupBy("customer_id", month_start("payment_ts").alias("month"))
        .agg(F.sum("amount").alias("paid_amount"))
    )


def customer_payment_days(daily: DataFrame) -> DataFrame:
    """One row per customer: number of payment days and the last of them."""
    return daily.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_payment_days"),
        F.max("payment_date").alias("last_payment_date"),
    )


def monthly_payments_of_portfolio(snapshot: DataFrame, monthly: DataFrame) -> DataFrame:
    """Customer-months with payments, summed over the join with the snapshot.

    That join repeats each payment for every account of the customer, so the
    sum is the customer's month total times the number of accounts: both sides
    are reduced to one row per customer-month before they meet.
    """
    accounts = snapshot.groupBy(*CUSTOMER_MONTH).agg(F.count(F.lit(1)).alias("n_accounts"))
    return accounts.join(monthly, CUSTOMER_MONTH).select(
        *CUSTOMER_MONTH,
        (F.col("paid_amount") * F.col("n_accounts")).alias("total_paid_amount"),
    )


def attach_portfolio_payments(accounts: DataFrame, monthly: DataFrame) -> DataFrame:
    """Each account with ``monthly_payments_of_portfolio`` of its customer-month.

    ``accounts`` must hold all accounts of a customer-month or none (as after
    the exclusion, which drops whole customer-months): the number of accounts
    is counted here (at most ten per group), so the snapshot is built once.
    """
    same_customer = Window.partitionBy(*CUSTOMER_MONTH)
    return (
        accounts.withColumn("n_accounts", F.count(F.lit(1)).over(same_customer))
        .join(monthly, CUSTOMER_MONTH, "left")
        .withColumn(
            "total_paid_amount",
            F.coalesce(F.col("paid_amount") * F.col("n_accounts"), F.lit(0)),
        )
        .drop("paid_amount", "n_accounts")
    )


def post_assignment_recovery(accounts: DataFrame, daily: DataFrame) -> DataFrame:
    """Accounts with the payments of the same month on or after their record date.

    One row per account and payment day; accounts without such a day keep one
    row with 0. Hash or merge join on (customer, month), the day comparison is
    a residual of it. Both sides are bounded per key: ten accounts, 31 days.
    """
    a, p = accounts.alias("a"), daily.alias("p")
    on = (
        (F.col("a.customer_id") == F.col("p.customer_id"))
        & (F.col("a.month") == F.col("p.month"))
        & (F.col("p.payment_date") >= F.col("a.record_date"))
    )
    return a.join(p, on, "left").select(
        "a.*",
        "p.payment_date",
        F.coalesce(F.col("p.paid_amount"), F.lit(0)).alias("recovered_amount"),
    )


def recovery_by_account(accounts: DataFrame, daily: DataFrame) -> DataFrame:
    """Each account with ``n_days``, the days of ``post_assignment_recovery``, and the
    sum of their payments.

    Accounts and payment days of a customer-month stand in one order, latest day first
    and payments before the accounts of their day: what an account recovers is the
    running total where it stands. So no account is repeated per payment day and none
    is put together again by all its columns. A group has at most ten accounts and 31 days.
    """
    columns = accounts.columns
    # A payment day has no account columns; which side a row is from, _payment says.
    days = daily.select(
        *CUSTOMER_MONTH,
        F.col("payment_date").alias("record_date"),
        F.col("paid_amount").alias("_paid"),
        F.lit(1).alias("_payment"),
    )
    since = (
        Window.partitionBy(*CUSTOMER_MONTH)
        .orderBy(F.desc("record_date"), F.desc("_payment"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        accounts.withColumn("_payment", F.lit(0))
        .unionByName(days, allowMissingColumns=True)
        .withColumns(
            {
                "n_days": F.sum("_payment").over(since),
                "recovered_amount": F.coalesce(F.sum("_paid").over(since), F.lit(0)),
            }
        )
        .where("_payment = 0")
        .select(*columns, "n_days", "recovered_amount")
    )


def paid_once(accounts: DataFrame, amount: str) -> DataFrame:
    """``amount`` at the first account of each customer-month, 0 at the others.

    The first account has the earliest record date, then the smallest id, so an
    amount that covers the days since then holds all that the others hold. At
    most ten rows form a group, and joins by customer-month have dealt them so.
    """
    first = Window.partitionBy(*CUSTOMER_MONTH).orderBy("record_date", "account_id")
    return (
        accounts.withColumn("_place", F.row_number().over(first))
        .withColumn(amount, F.when(F.col("_place") == 1, F.col(amount)).otherwise(F.lit(0)))
        .drop("_place")
    )


def net_recovery(accounts: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per account with the payments since its record date, each payment
    once: a customer-month's are those since its first record date, and they
    stand at the account that has it. The balance counts once, too.
    """
    return paid_once(recovery_by_account(accounts, daily).drop("n_days"), "recovered_amount")
