"""Call interactions: contact, agreements, promises and outcome categories."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearly.functions.bands import outcome_category, promise_end_date, strip_check_digit
from arrearly.functions.calendar import day, month_start
from arrearly.functions.digests import row_digest
from arrearly.operators.keys import CUSTOMER_MONTH
from arrearly.params import DayWindow


# What counts and categories of calls read of an event.
CALL_COLUMNS = ("account_id", "start_ts", "kind", "outcome_code")
# Assumed bytes of a value, and those of a digest in a shuffled row.
_WIDTHS = {T.StringType: 20, T.BinaryType: 100, T.DecimalType: 16, T.BooleanType: 1, T.IntegerType: 4}
_DIGEST = 32


def distinct_interactions(
    interactions: DataFrame, used: Sequence[str] | None = None
) -> DataFrame:
    """Events without exact copies. Every column of the table takes part, also
    those that no analysis reads.

    A caller that reads few columns names them and gets only those. Where the others are
    wider than a digest, rows are compared by the SHA-256 of all their values, so
    what is shuffled per event does not grow with the columns of the source.
    """
    if used is None:
        return interactions.dropDuplicates()
    others = [f.dataType for f in interactions.schema.fields if f.name not in used]
    if sum(_WIDTHS.get(type(t), 8) for t in others) > _DIGEST:
        digest = row_digest(interactions)
        if digest is not None:
            return interactions.select(digest.alias("_row"), *used).distinct().drop("_row")
    return interactions.dropDuplicates().select(*used)


def phone_calls(
    interactions: DataFrame, kind: str, window: DayWindow, strip: bool = True
) -> DataFrame:
    """Telephone events of the window with their day, customer and month."""
    return interactions.where(
        (F.col("kind") == kind) & window.by_day("start_ts")
    ).withColumns(
        {
            "call_day": day("start_ts"),
            "month": month_start("start_ts"),
            "customer_id": strip_check_digit("account_id") if strip else F.col("account_id"),
        }
    )


def contacted_customers(interactions: DataFrame, kind: str, window: DayWindow) -> DataFrame:
    """Customer-months with at least one telephone event.

    Copies cannot change which customer-months occur, so the events are reduced
    to the two keys without the whole-row DISTINCT.
    """
    return phone_calls(interactions, kind, window).select(CUSTOMER_MONTH).distinct()


def agreements(
    interactions: DataFrame, kind: str, codes: Sequence[int], window: DayWindow
) -> DataFrame:
    """Customer-months with at least one payment agreement by telephone."""
    return (
        phone_calls(interactions, kind, window)
        .where(F.col("outcome_code").isin(*codes))
        .select(CUSTOMER_MONTH)
        .distinct()
    )


def contact_activity(
    interactions: DataFrame,
    kind: str,
    rpc_codes: Sequence[int],
    agreement_codes: Sequence[int],
    window: DayWindow,
) -> DataFrame:
    """Distinct calls per customer and month: all, effective contacts, agreements."""
    events = distinct_interactions(interactions, CALL_COLUMNS)
    return phone_calls(events, kind, window).groupBy(*CUSTOMER_MONTH).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(F.col("outcome_code").isin(*rpc_codes)).alias("total_contacts"),
        F.count_if(F.col("outcome_code").isin(*agreement_codes)).alias("total_agreements"),
    )


def attach_contact(accounts: DataFrame, activity: DataFrame) -> DataFrame:
    """Accounts with their customer's calls of the month; no calls count as 0."""
    counts = ["total_calls", "total_contacts", "total_agreements"]
    return (
        accounts.join(activity, CUSTOMER_MONTH, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
        .withColumn("is_contacted", F.when(F.col("total_contacts") > 0, 1).otherwise(0))
    )


def promise_calls(
    interactions: DataFrame, kind: str, window: DayWindow, strip: bool = False
) -> DataFrame:
    """Distinct (customer, kind, outcome, agent, day, promise end) of the calls.

    The promise end date is part of the DISTINCT: calls that differ only in
    their term are two rows.
    """
    return (
        phone_calls(interactions, kind, window, strip)
        .select(
            "customer_id",
            "kind",
            "outcome_code",
            "agent_id",
            "call_day",
            promise_end_date("call_day", "term_weeks").alias("promise_end_date"),
        )
        .distinct()
    )


def customer_calls(
    calls: DataFrame,
    rpc_codes: Sequence[int],
    agreement_codes: Sequence[int],
    system_code: int,
) -> DataFrame:
    """One row per customer: number of calls and the funnel stages reached.

    A call without an outcome code is not a dialled one.
    """
    code = F.col("outcome_code")
    return calls.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_calls"),
        (F.count_if(code != system_code) > 0).alias("dialed"),
        (F.count_if(code.isin(*rpc_codes)) > 0).alias("rpc"),
        (F.count_if(code.isin(*agreement_codes)) > 0).alias("agreed"),
    )


def outcome_volume(
    interactions: DataFrame,
    kind: str,
    window: DayWindow,
    taxonomy: Mapping[str, Iterable[int]],
) -> DataFrame:
    """Distinct calls per month and executive outcome category."""
    return (
        phone_calls(distinct_interactions(interactions, CALL_COLUMNS), kind, window)
        .withColumn("outcome_category", outcome_category("outcome_code", taxonomy))
        .groupBy("month", "outcome_category")
        .agg(F.count(F.lit(1)).alias("calls"))
    )
