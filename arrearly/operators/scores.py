"""Predictive scores per customer and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearly.functions.calendar import month_start
from arrearly.operators.keys import CUSTOMER_MONTH
from arrearly.params import DayWindow, score_window

SCORE_COLUMNS = [
    "contact_score", "agreement_score", "payment_score", "general_score", "payment_rank",
]
# Room for any count of rows, and small enough that count x money keeps its cents.
ROW_COUNT = "decimal(13,0)"


def scores_by_month(scores: DataFrame, window: DayWindow, lag_months: int = 0) -> DataFrame:
    """Scores whose month meets a portfolio month of the window.

    As published (``lag_months=0``) a month's score, cut off at its end, meets
    the accounts of that same month; the window opens one day early, which
    admits the previous month-end, and it meets no account. With a lag the
    scores of the whole months that lie so many months earlier meet them,
    whatever day of the month they were cut off.
    """
    cutoffs = score_window(window, lag_months)
    return scores.where(cutoffs.by_day("cutoff_date")).withColumn(
        "month", F.add_months(month_start("cutoff_date"), lag_months)
    )


def score_attach(accounts: DataFrame, monthly_scores: DataFrame) -> DataFrame:
    """Accounts with each score row of their customer-month, NULLs where none.

    Two parts instead of one outer join: a customer-month may have any number of
    score rows, and adaptive execution splits a hot key only on the side an
    outer join preserves. In the inner join it can split the scores.
    """
    scores = [c for c in SCORE_COLUMNS if c in monthly_scores.columns]
    scored = accounts.join(monthly_scores.select(*CUSTOMER_MONTH, *scores), CUSTOMER_MONTH)
    unscored = accounts.join(
        monthly_scores.select(CUSTOMER_MONTH).distinct(), CUSTOMER_MONTH, "left_anti"
    )
    return scored.unionByName(unscored, allowMissingColumns=True)


def score_counts(monthly_scores: DataFrame, *by: str) -> DataFrame:
    """Number of score rows per customer-month and value of ``by``.

    Aggregations need only how often an account repeats for its scores, so the
    repeats travel as a count and a hot customer-month stays small.
    """
    return monthly_scores.groupBy(*CUSTOMER_MONTH, *by).agg(
        F.count(F.lit(1)).alias("score_rows")
    )


def attach_score_counts(accounts: DataFrame, counts: DataFrame) -> DataFrame:
    """Accounts with ``score_counts``; an account without scores counts once."""
    return accounts.join(counts, CUSTOMER_MONTH, "left").withColumn(
        "score_rows", F.coalesce(F.col("score_rows"), F.lit(1)).cast(ROW_COUNT)
    )


def attach_score_bands(
    accounts: DataFrame, monthly_scores: DataFrame, band: Column, labels: list[str], name: str
) -> DataFrame:
    """As ``attach_score_counts`` by a column with few, known values.

    One count per label and customer-month keeps the scores' aggregation
    partitioned by the join keys, so that it is shuffled once. ``labels[-1]`` is
    the band of an account without a score.
    """
    counts = monthly_scores.groupBy(*CUSTOMER_MONTH).agg(
        *[F.count_if(band == label).alias(f"_{i}") for i, label in enumerate(labels)]
    )
    rows = [F.coalesce(F.col(f"_{i}"), F.lit(0)) for i in range(len(labels))]
    rows[-1] = F.when(F.col("_0").isNull(), F.lit(1)).otherwise(rows[-1])
    bands = F.array(
        *[
            F.struct(F.lit(label).alias(name), n.cast(ROW_COUNT).alias("score_rows"))
            for label, n in zip(labels, rows)
        ]
    )
    return (
        accounts.join(counts, CUSTOMER_MONTH, "left")
        .select(*accounts.columns, F.inline(bands))
        .where("score_rows > 0")
    )


def latest_scores(monthly_scores: DataFrame) -> DataFrame:
    """One score row per customer-month: the last cutoff, ties by the values."""
    scores = [c for c in SCORE_COLUMNS if c in monthly_scores.columns]
    last = Window.partitionBy(*CUSTOMER_MONTH).orderBy(
        F.desc("cutoff_date"), *[F.asc_nulls_last(c) for c in scores]
    )
    return (
        monthly_scores.withColumn("rn", F.row_number().over(last))
        .where("rn = 1")
        .select(*CUSTOMER_MONTH, *scores)
    )
