"""Every operator and analysis as a query over the test tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import arrearly as a
from arrearly.functions import bands
from arrearly.functions.calendar import month_key
from arrearly.functions.rounding import percent
from arrearly.operators import activity, metrics, payments, portfolio, scores
from arrearly.params import AGREEMENT_CODES, OUTCOME_TAXONOMY, RPC_CODES, rolling_months
from arrearly.plans import efficiency, funnel, states
from arrearly.sources.layout import read_months, write_tables
from arrearly.sources.storage import shared_folder
from arrearly.sources.tables import conform
from arrearly.sources.times import parse_times, rejected_counts
from catalog.fixtures import (
    EXPOSURE_DATE,
    FUNNEL,
    PIVOT,
    SPAN,
    WHOLE,
    YEAR,
    StarTables,
    replace,
    single_id,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# The same queries as functions of the input tables.
BUILDERS: dict[str, Callable[[a.Tables], DataFrame]] = {}


def query(build: Callable[[a.Tables], DataFrame]) -> Callable[[a.Tables], DataFrame]:
    """Register a query over the two-id-space tables under its function name."""
    return _register(build, lambda t: t)


def single_id_query(build: Callable[[a.Tables], DataFrame]):
    """As ``query``, with customer ids as account ids throughout."""
    return _register(build, single_id)


def _register(build, adapt):
    def on_tables(tables: a.Tables) -> DataFrame:
        return comparable(build(adapt(tables)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_tables(StarTables(spark, sf_dir))

    BUILDERS[build.__name__] = on_tables
    QUERIES[build.__name__] = run
    return build


def comparable(df: DataFrame) -> DataFrame:
    """Types that every client of both engines reads alike: decimals and numbers
    that may be NULL as doubles, dates as text, flags as integers."""
    targets = {T.DecimalType: "double", T.DateType: "string", T.BooleanType: "int"}
    casts = {f.name: targets.get(type(f.dataType)) for f in df.schema.fields}
    casts |= {name: "double" for name in ("payment_rank", "customer_age") if name in casts}
    return df.withColumns(
        {name: F.col(f"`{name}`").cast(to) for name, to in casts.items() if to}
    )


def _snapshot(t: a.Tables) -> DataFrame:
    return portfolio.first_of_month_snapshot(t.portfolio, SPAN)


def _managed(t: a.Tables) -> DataFrame:
    return portfolio.managed_accounts(t.portfolio, t.third_party, WHOLE)


def _daily(t: a.Tables) -> DataFrame:
    return payments.daily_payments(t.payments, WHOLE.payment_kind, SPAN)


def _text_month(df: DataFrame) -> DataFrame:
    return portfolio.with_month_year(df).drop("month")


# --- snapshot and exclusion -------------------------------------------------


@query
def snapshot_first_of_month(t):
    return _text_month(_snapshot(t)).select(
        "account_id", "customer_id", "load_id", "record_date", "month_year",
        "risk_bucket", "balance",
    )


@query
def risk_bucket_counts(t):
    return (
        t.portfolio.groupBy("past_due", bands.risk_bucket("past_due").alias("risk_bucket"))
        .agg(F.count(F.lit(1)).alias("loads"))
    )


@query
def strip_check_digit(t):
    return (
        t.portfolio.groupBy(bands.strip_check_digit("account_id").alias("customer_id"))
        .agg(
            F.countDistinct("account_id").alias("accounts"),
            F.count(F.lit(1)).alias("loads"),
        )
    )


@query
def month_key_volume(t):
    return (
        t.portfolio.groupBy(
            month_key("load_ts").alias("month_year"),
            F.last_day(F.to_date("load_ts")).alias("month_end"),
        )
        .agg(F.count(F.lit(1)).alias("loads"), F.sum("balance").alias("balance"))
    )


@query
def exclusion_list_monthly(t):
    return _text_month(
        portfolio.third_party_exclusions(t.third_party, WHOLE.channels, SPAN)
    )


@query
def exclusion_list_window(t):
    return portfolio.third_party_exclusions(
        t.third_party, WHOLE.channels, FUNNEL.window, monthly=False
    )


@query
def portfolio_after_exclusion(t):
    return _text_month(_managed(t)).select(
        "account_id", "customer_id", "month_year", "risk_bucket"
    )


@query
def portfolio_after_exclusion_window(t):
    excluded = portfolio.third_party_exclusions(
        t.third_party, WHOLE.channels, FUNNEL.window, monthly=False
    )
    return _text_month(portfolio.exclude_third_party(_snapshot(t), excluded)).select(
        "account_id", "customer_id", "month_year", "risk_bucket"
    )


@query
def uncast_window_payments(t):
    """Payments inside the window by day, and by raw timestamp."""
    by_day, by_instant = YEAR.by_day("payment_ts"), YEAR.by_instant("payment_ts")
    return t.payments.groupBy("payment_kind").agg(
        F.count_if(by_day).alias("payments_by_day"),
        F.count_if(by_instant).alias("payments_by_instant"),
        F.sum(F.when(by_day, F.col("amount"))).alias("amount_by_day"),
        F.sum(F.when(by_instant, F.col("amount"))).alias("amount_by_instant"),
    )


# --- calls -------------------------------------------------------------------


@query
def interactions_distinct(t):
    return (
        activity.distinct_interactions(t.interactions)
        .groupBy(month_key("start_ts").alias("month_year"), "kind")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query
def contact_activity_monthly(t):
    calls = activity.contact_activity(
        t.interactions, WHOLE.phone_kind, RPC_CODES, AGREEMENT_CODES, SPAN
    )
    return _text_month(calls)


@query
def contact_activity_wide(t):
    """Calls with ten long columns that no analysis reads, but the whole-row DISTINCT does."""
    notes = {
        f"note_{i}": F.repeat(F.sha2(F.concat_ws("|", F.lit(i), "agent_id", "start_ts"), 256), 3)
        for i in range(10)
    }
    calls = activity.contact_activity(
        t.interactions.withColumns(notes), WHOLE.phone_kind, RPC_CODES, AGREEMENT_CODES, SPAN
    )
    return _text_month(calls)


@query
def contact_flags(t):
    calls = activity.contact_activity(
        t.interactions, WHOLE.phone_kind, RPC_CODES, AGREEMENT_CODES, SPAN
    )
    return _text_month(activity.attach_contact(_managed(t), calls)).select(
        "account_id", "month_year", "total_contacts", "is_contacted"
    )


@query
def agreements_monthly(t):
    return _text_month(
        activity.agreements(t.interactions, WHOLE.phone_kind, AGREEMENT_CODES, SPAN)
    )


@query
def non_system_calls(t):
    """Customers and their funnel flags over all calls."""
    calls = activity.promise_calls(t.interactions, WHOLE.phone_kind, SPAN, strip=True)
    return activity.customer_calls(calls, RPC_CODES, AGREEMENT_CODES, WHOLE.system_code)


@query
def promise_end_dates(t):
    calls = activity.promise_calls(t.interactions, WHOLE.phone_kind, SPAN, strip=True)
    return calls.groupBy("call_day", "promise_end_date").agg(
        F.count(F.lit(1)).alias("calls")
    )


@query
def outcome_taxonomy(t):
    return _text_month(
        activity.outcome_volume(t.interactions, WHOLE.phone_kind, SPAN, OUTCOME_TAXONOMY)
    )


# --- payments ------------------------------------------------------------------


@query
def daily_payments(t):
    return _text_month(_daily(t))


@query
def monthly_portfolio_payments(t):
    monthly = payments.monthly_payments(t.payments, WHOLE.payment_kind, SPAN)
    return _text_month(payments.monthly_payments_of_portfolio(_snapshot(t), monthly))


@query
def post_assignment_recovery(t):
    return _text_month(payments.post_assignment_recovery(_managed(t), _daily(t))).select(
        "account_id", "month_year", "record_date", "payment_date", "balance",
        "recovered_amount",
    )


@query
def post_assignment_recovery_net(t):
    accounts = _managed(t).select(
        "account_id", "customer_id", "month", "record_date", "balance"
    )
    return _text_month(payments.net_recovery(accounts, _daily(t)))


# --- scores ----------------------------------------------------------------------


def _attached(t, lag_months):
    monthly = scores.scores_by_month(t.scores, SPAN, lag_months)
    accounts = _managed(t).select("account_id", "customer_id", "month")
    return _text_month(scores.score_attach(accounts, monthly))


@query
def score_attach(t):
    return _attached(t, 0)


@query
def score_attach_previous_month(t):
    return _attached(t, 1)


@query
def score_row_counts(t):
    monthly = scores.scores_by_month(t.scores, SPAN)
    return _text_month(scores.score_counts(monthly, "payment_rank"))


@query
def latest_scores(t):
    return _text_month(scores.latest_scores(scores.scores_by_month(t.scores, SPAN)))


def _attached_in_year(t, lag_months):
    """Scores of months before the window meet its first accounts."""
    settings = WHOLE.during(YEAR)
    monthly = scores.scores_by_month(t.scores, YEAR, lag_months)
    accounts = portfolio.managed_accounts(t.portfolio, t.third_party, settings)
    return _text_month(
        scores.score_attach(accounts.select("account_id", "customer_id", "month"), monthly)
    )


@query
def score_attach_lag2(t):
    return _attached_in_year(t, 2)


@query
def score_attach_midmonth(t):
    """Cutoffs ten days before the end of a month, and a lag of one month."""
    early = t.scores.withColumn("cutoff_date", F.date_sub("cutoff_date", 10))
    return _attached_in_year(replace(t, scores=early), 1)


# --- bands -------------------------------------------------------------------------


def _mix(t, **columns):
    return (
        _snapshot(t)
        .groupBy(*[c.alias(n) for n, c in columns.items()])
        .agg(F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("balance"))
    )


@query
def age_bracket_mix(t):
    age = bands.age_years("birth_date", "record_date")
    return _mix(t, customer_age=age, age_bracket=bands.age_bracket(age))


@query
def saturation_mix(t):
    return _mix(t, saturation_range=bands.saturation_range("saturation_pct"))


@query
def recency_mix(t):
    return _mix(
        t,
        contact_recency_range=bands.contact_recency_range("last_contact_date", "record_date"),
    )


@query
def reason_mix(t):
    return _mix(t, non_payment_reason_code=bands.reason_or_zero("reason_code"))


@query
def load_tier_mix(t):
    return _mix(t, financial_load_tier=bands.financial_load_tier("balance", "income"))


@query
def financial_load_pct(t):
    return _snapshot(t).select(
        "account_id",
        "load_id",
        bands.financial_load_pct("balance", "income").alias("financial_load_pct"),
    )


@query
def contactability_mix(t):
    return t.scores.groupBy(
        bands.contactability_tier("contact_score").alias("contactability_tier")
    ).agg(
        F.count(F.lit(1)).alias("score_rows"), F.sum("contact_score").alias("score_sum")
    )


@query
def amount_due_by_branch(t):
    due = metrics.exposure_due(t.exposure, EXPOSURE_DATE)
    overdue, current = F.col("overdue_balance"), F.col("current_balance")
    branch = (
        F.when(overdue <= 0, "base fee")
        .when(current == overdue, "overdue")
        .otherwise("overdue and fee")
    )
    return due.groupBy(branch.alias("branch")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("amount_due").alias("amount_due")
    )


# --- efficiency -----------------------------------------------------------------------


def _efficiency_by(t, *dims):
    mesh = efficiency.score_mesh(t, WHOLE)
    return metrics.efficiency_mesh(
        mesh,
        dims,
        F.countDistinct("customer_id").alias("total_customers"),
        F.sum("mesh_rows").alias("mesh_rows"),
        balance=F.col("balance") * F.col("mesh_rows"),
        recovered=F.col("recovered_amount") * F.col("score_rows"),
    )


@query
def efficiency_by_score_tier(t):
    return _efficiency_by(t, bands.score_tier_label("payment_rank").alias("category"))


@query
def efficiency_by_bucket(t):
    return _efficiency_by(t, bands.bucket_label("risk_bucket").alias("category"))


@query
def efficiency_by_month(t):
    """Coverage of payments: recovery ratio per month, once per balance."""
    accounts = _managed(t).select(
        "account_id", "customer_id", "month", "record_date", "balance"
    )
    mesh = portfolio.with_month_year(payments.net_recovery(accounts, _daily(t)))
    return (
        mesh.groupBy("month_year")
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            F.sum("balance").alias("balance"),
            F.sum("recovered_amount").alias("recovered"),
        )
        .withColumn("efficiency_pct", percent(F.col("recovered"), F.col("balance")))
    )


@query
def wide_money_percent(t):
    """Percentages of money a million million times as large, beyond 64 bits."""
    wide = F.col("balance").cast("decimal(24,2)") * F.lit(Decimal(10**12))
    return (
        _snapshot(t)
        .groupBy("risk_bucket")
        .agg(percent(F.sum(wide), F.count(F.lit(1))).alias("pct"))
        .withColumn("pct", F.col("pct").cast("string"))
    )


# --- full analyses ---------------------------------------------------------------------


@query
def p01a(t):
    return a.assigned_by_month(t, PIVOT)


@query
def p01a_stripped(t):
    return a.assigned_by_month(t, PIVOT, strip=True)


@query
def p01a_no_load_id(t):
    """Loads of one day are ordered by the columns that the analysis uses."""
    return a.assigned_by_month(replace(t, portfolio=t.portfolio.drop("load_id")), PIVOT)


@query
def p01b(t):
    return a.covered_customers(t, WHOLE)


@query
def p02(t):
    return a.score_efficiency(t, WHOLE)


@query
def p02_net(t):
    return a.score_efficiency(t, WHOLE, net=True)


@query
def p03(t):
    return a.demographic_efficiency(t, WHOLE)


@query
def p03_net(t):
    return a.demographic_efficiency(t, WHOLE, net=True)


@query
def p03_no_load_id(t):
    return a.demographic_efficiency(replace(t, portfolio=t.portfolio.drop("load_id")), WHOLE)


@query
def p04(t):
    return a.consolidated_efficiency(t, WHOLE)


@query
def p04_net(t):
    return a.consolidated_efficiency(t, WHOLE, net=True)


@single_id_query
def p05(t):
    return a.monthly_funnel(t, FUNNEL)


@single_id_query
def p05_net(t):
    return a.monthly_funnel(t, FUNNEL, net=True)


@query
def p06(t):
    return a.agreements_by_month(t, PIVOT)


@query
def p07(t):
    return a.predictive_efficiency(t, WHOLE)


@query
def p07_net(t):
    return a.predictive_efficiency(t, WHOLE, net=True)


@query
def kpi_rates(t):
    return a.kpis_by_month(t, WHOLE)


@query
def rolling_kpis(t):
    """The KPIs over all months of the data."""
    return a.rolling_kpis(t, SPAN.end, 84, WHOLE)


@query
def rolling_kpis_year(t):
    """The published twelve months."""
    return a.rolling_kpis(t, YEAR.end, settings=WHOLE)


@single_id_query
def funnel_rates(t):
    return metrics.kpi_rates(a.funnel_counts(t, FUNNEL))


@query
def rolling_months_pivot(t):
    """Assigned customers by bucket over all months of the data."""
    window = rolling_months(SPAN.end, 84)
    accounts = portfolio.managed_accounts(t.portfolio, t.third_party, WHOLE.during(window))
    customers = accounts.select("customer_id", "month", "risk_bucket").distinct()
    return metrics.month_pivot(
        portfolio.with_month_year(customers), "risk_bucket", window.month_keys()
    )


# --- the source vocabularies -------------------------------------------------------------


def _as_read(t, names):
    """The inputs under the names of a vocabulary, read back into the canonical ones."""
    frames = {}
    for table, columns in names.items():
        source = getattr(t, table).withColumnsRenamed({c: s for s, c in columns.items()})
        frames[table] = conform(source, table, columns)
    return a.Tables(**frames)


@query
def p02_staging_names(t):
    return a.score_efficiency(_as_read(t, a.STAGING_NAMES), WHOLE)


@single_id_query
def p05_core_names(t):
    return a.monthly_funnel(_as_read(t, a.CORE_NAMES), FUNNEL)


@query
def p07_directory_names(t):
    return a.predictive_efficiency(_as_read(t, a.DIRECTORY_NAMES), WHOLE)


# --- tables stored by month --------------------------------------------------------------


def _stored(t: a.Tables, settings: a.Settings, *names: str) -> a.Tables:
    """The tables written by month, and of them the months that ``settings`` need."""
    spark = t.portfolio.sparkSession
    root = shared_folder(spark, "months")
    write_tables(t, root, names)
    return read_months(spark, root, settings, names)


@query
def p01a_by_month(t):
    return a.assigned_by_month(_stored(t, PIVOT, "portfolio", "third_party"), PIVOT)


@query
def p02_by_month(t):
    stored = _stored(t, WHOLE, "portfolio", "third_party", "scores", "payments")
    return a.score_efficiency(stored, WHOLE)


@single_id_query
def p05_by_month(t):
    names = ("portfolio", "third_party", "interactions", "payments", "exposure")
    return a.monthly_funnel(_stored(t, FUNNEL, *names), FUNNEL)


@query
def rolling_kpis_by_month(t):
    window = rolling_months(YEAR.end, 12)
    stored = _stored(
        t, WHOLE.during(window), "portfolio", "third_party", "interactions", "payments"
    )
    return a.rolling_kpis(stored, YEAR.end, settings=WHOLE)


# --- times as text ----------------------------------------------------------------------


def _as_text(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, pattern) for c in columns})


@single_id_query
def p05_text_times(t):
    """Every table with its times as text, each in another style."""
    second = "yyyy-MM-dd HH:mm:ss"
    texts = {
        "portfolio": (_as_text(t.portfolio, "dd/MM/yyyy HH:mm:ss", "load_ts"), "day_first"),
        "third_party": (_as_text(t.third_party, "MM/dd/yyyy HH:mm", "load_ts"), "month_first"),
        "interactions": (_as_text(t.interactions, second, "start_ts"), "iso"),
        "payments": (_as_text(t.payments, "yyyy-MM-dd'T'HH:mm:ss.SSS", "payment_ts"), "iso"),
        "exposure": (_as_text(t.exposure, "yyyyMMdd", "snapshot_date"), "compact"),
    }
    frames = {n: parse_times(df, n, style).rows for n, (df, style) in texts.items()}
    return a.monthly_funnel(replace(t, **frames), FUNNEL)


@query
def rejected_times(t):
    """Calls with texts that are no times: how many rows are kept, and why not the others."""
    digit = F.col("agent_id") % 5
    start = F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(digit == 0, F.concat(F.date_format("start_ts", "yyyy-MM"), F.lit("-32")))
        .when(digit == 1, F.date_format("start_ts", "dd/MM/yyyy"))
        .when(digit == 2, F.lit(None))
        .otherwise(start)
    )
    calls = parse_times(t.interactions.withColumn("start_ts", text), "interactions")
    kept = calls.rows.groupBy(F.lit("kept").alias("fault")).agg(F.count(F.lit(1)).alias("rows"))
    return rejected_counts(calls.rejected).unionByName(kept)


# --- month states -------------------------------------------------------------------------


@query
def kpi_rates_from_states(t):
    return states.kpis_from_states(a.kpi_states(t, WHOLE))


@query
def rolling_kpis_month_added(t):
    """Eleven months of states, and then the twelfth, from the stored tables of its month."""
    spark, root = t.portfolio.sparkSession, shared_folder(t.portfolio.sparkSession, "states")
    before = WHOLE.during(rolling_months(date(1996, 12, 31), 11))
    # Only the last day of the whole window is cut short.
    a.write_states(a.kpi_states(t, dataclasses.replace(before, whole_last_day=True)), root)
    month = WHOLE.during(rolling_months(YEAR.end, 1))
    stored = _stored(t, month, "portfolio", "third_party", "interactions", "payments")
    a.write_states(a.kpi_states(stored, month), root)
    return a.rolling_kpis_from_states(spark, root, YEAR.end)


@query
def span_kpis(t):
    """Customers once over all months, with ids moved up to the end of the 64-bit range."""
    customers = metrics.customer_kpis(funnel.kpi_accounts(t, WHOLE)).withColumn(
        "customer_id", F.lit(2**63 - 1) - F.col("customer_id")
    )
    stages = {"assigned": F.lit(True), "rpc": F.col("rpc"), "agreed": F.col("agreed")}
    sets = states.customer_sets(customers, ["month", "risk_bucket"], stages)
    return states.set_sizes(sets, ["risk_bucket"], states.COUNTS)


# --- published order ---------------------------------------------------------------------


def _positions(result, *keys):
    """The place of every result row, and what the published order looks at. The
    results have one row per segment, so they fit one task."""
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    return result.select(place.alias("place"), *keys)


@query
def p01b_order(t):
    return _positions(a.covered_customers(t, WHOLE), "month_year", "risk_bucket")


@query
def p02_order(t):
    return _positions(a.score_efficiency(t, WHOLE), "analysis_type", "category")


@query
def p04_order(t):
    result = a.consolidated_efficiency(t, WHOLE)
    return _positions(result, "risk_bucket", "age_bracket", "real_efficiency_pct")


@single_id_query
def p05_order(t):
    return _positions(a.monthly_funnel(t, FUNNEL), "mora_bucket")
