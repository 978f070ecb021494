"""Row order, published columns, settings, and relations between results."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

import arrearly as a
from arrearly.operators import scores
from arrearly.operators.activity import (
    contact_activity,
    customer_calls,
    distinct_interactions,
    promise_calls,
)
from arrearly.operators.portfolio import managed_accounts
from arrearly.params import AGREEMENT_CODES, RPC_CODES, rolling_months
from catalog.fixtures import FUNNEL, PIVOT, WHOLE, StarTables, single_id
from support import rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return StarTables(spark, SF_DIR)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_published_columns(tables):
    assert a.assigned_by_month(tables).columns == [
        "risk_bucket", *a.STAGING.window.month_keys(),
    ]
    assert a.agreements_by_month(tables).columns == [
        "bucket_mora", "jun_2025", "jul_2025", "ago_2025", "sep_2025", "oct_2025", "nov_2025",
        "dic_2025", "ene_2026", "feb_2026", "mar_2026", "abr_2026", "may_2026", "jun_2026",
    ]
    assert a.covered_customers(tables).columns == [
        "month_year", "risk_bucket", "covered_customers",
    ]
    totals = ["total_customers", "total_assigned_balance", "total_recovered_amount"]
    assert a.score_efficiency(tables).columns == [
        "analysis_type", "category", *totals, "efficiency_percentage",
    ]
    assert a.demographic_efficiency(tables).columns == [
        "risk_bucket", "non_payment_reason_code", "age_bracket", "saturation_range",
        "contact_recency_range", "total_customers", "avg_group_age", *totals[1:],
        "real_efficiency_pct",
    ]
    assert a.consolidated_efficiency(tables).columns == [
        "risk_bucket", "punctuality_score", "age_bracket", "contactability_tier",
        "financial_load_tier", "total_customers", "avg_monthly_income", *totals[1:],
        "real_efficiency_pct",
    ]
    assert a.monthly_funnel(single_id(tables)).columns == [
        "mora_bucket", "total_cartera_asignada", "clientes_llamada_enlazada",
        "clientes_contacto_efectivo", "clientes_con_convenio", "clientes_pagadores",
        "exigible_total_monto",
    ]
    assert a.predictive_efficiency(tables).columns == [
        "bucket_mora", "rango_edad", "total_clientes", "ingreso_promedio",
        "eficiencia_teorica_pct", "eficiencia_real_pct",
    ]


def test_money_stays_decimal(tables):
    types = dict(a.consolidated_efficiency(tables, WHOLE).dtypes)
    assert types["total_assigned_balance"].startswith("decimal(")
    assert types["real_efficiency_pct"] == "decimal(30,2)"


def test_row_order(tables):
    assert column(a.assigned_by_month(tables, PIVOT), "risk_bucket") == list(range(1, 8))
    covered = [(r[0], r[1]) for r in a.covered_customers(tables, WHOLE).collect()]
    assert covered == sorted(covered)

    tiers = [(r[0], r[1]) for r in a.score_efficiency(tables, WHOLE).collect()]
    # Text order, with the accounts without a score last in their block.
    scored = [t for t in tiers if t[0] == "By Predictive Score"]
    assert scored[-1][1] is None
    assert scored[:4] == [
        ("By Predictive Score", f"Score Tier {n}") for n in (0, 1, 10, 11)
    ]
    assert tiers[len(scored):] == [("By Risk Bucket", f"Bucket {n}") for n in range(1, 8)]

    mesh = a.consolidated_efficiency(tables, WHOLE).collect()
    keys = [(r.risk_bucket, r.age_bracket, -r.real_efficiency_pct) for r in mesh]
    assert keys == sorted(keys)


def test_null_sorts_like_the_warehouse(random_tables):
    """NULL last ascending, first descending."""
    reason = column(a.demographic_efficiency(random_tables, WHOLE), "risk_bucket")
    assert reason == sorted(reason)
    labels = column(a.score_efficiency(random_tables, WHOLE), "category")
    first_block = labels[: labels.index(None) + 1]
    assert first_block[:-1] == sorted(first_block[:-1])


def test_long_form_equals_pivot(tables):
    wide = a.assigned_by_month(tables, PIVOT, strip=True)
    months = PIVOT.window.month_keys()
    cells = sum(sum(r[m] for m in months) for r in wide.collect())
    accounts = managed_accounts(
        tables.portfolio, tables.third_party, PIVOT, require_balance=False
    )
    assert cells == accounts.count() > 0


def test_pivot_zero_fill(tables):
    window = rolling_months(date(1997, 1, 31), 60)
    wide = a.assigned_by_month(tables, WHOLE.during(window))
    first = window.month_keys()[0]
    assert first == "1992-02"
    assert {r[first] for r in wide.collect()} == {0}


def test_funnel_stages_are_subsets(tables):
    for r in a.funnel_counts(single_id(tables), FUNNEL).collect():
        assert r.rpc_customers <= r.dialed_customers <= r.assigned_customers
        assert r.agreement_customers <= r.rpc_customers
        assert r.paying_customers <= r.assigned_customers


def test_net_counts_no_balance_twice(tables):
    both = [
        {(r[0], r[1]): r for r in a.score_efficiency(tables, WHOLE, net=net).collect()}
        for net in (False, True)
    ]
    buckets = [k for k in both[0] if k[0] == "By Risk Bucket"]
    for k in buckets:
        full, net = both[0][k], both[1][k]
        assert net.total_assigned_balance <= full.total_assigned_balance
        assert net.total_customers == full.total_customers
    once = managed_accounts(tables.portfolio, tables.third_party, WHOLE).agg(F.sum("balance"))
    assert sum(both[1][k].total_assigned_balance for k in buckets) == once.first()[0]


def test_score_attach_equals_outer_join(random_tables):
    accounts = managed_accounts(
        random_tables.portfolio, random_tables.third_party, WHOLE
    ).select("account_id", "customer_id", "month")
    monthly = scores.scores_by_month(random_tables.scores, WHOLE.window)
    columns = ["account_id", "customer_id", "month", *scores.SCORE_COLUMNS]
    outer = accounts.join(monthly, ["customer_id", "month"], "left")
    attached = scores.score_attach(accounts, monthly)
    assert rows(attached, *columns) == rows(outer, *columns)
    assert attached.where("payment_rank IS NULL").count() > 0


def test_score_lag_moves_scores_to_the_next_month(random_tables):
    window = a.DayWindow(date(1996, 5, 1), date(1996, 6, 30))
    same = scores.scores_by_month(random_tables.scores, window)
    lagged = scores.scores_by_month(random_tables.scores, window, lag_months=1)
    months = {d.month for d in column(same.select("month").distinct(), "month")}
    assert months == {4, 5, 6}      # April is admitted and meets no account
    months = {d.month for d in column(lagged.select("month").distinct(), "month")}
    assert months == {5, 6}         # the scores of April and May


def test_copies_are_dropped_but_terms_kept(random_tables):
    calls = random_tables.interactions
    assert distinct_interactions(calls).count() == len(set(calls.collect())) < calls.count()
    promises = promise_calls(calls, "O", WHOLE.window, strip=True)
    keys = ["customer_id", "kind", "outcome_code", "agent_id", "call_day"]
    assert promises.select(keys).distinct().count() < promises.count()


def test_unknown_columns_take_part_in_the_distinct(random_tables):
    """Two events that differ only in a column nobody reads are two events."""
    calls = random_tables.interactions
    marked = calls.withColumn("note", F.monotonically_increasing_id())
    args = ("O", RPC_CODES, AGREEMENT_CODES, WHOLE.window)
    plain = contact_activity(calls, *args).agg(F.sum("total_calls")).first()[0]
    noted = contact_activity(marked, *args).agg(F.sum("total_calls")).first()[0]
    assert noted == calls.where("kind = 'O'").count() > plain


def test_call_without_code_is_not_dialled(spark):
    calls = spark.createDataFrame(
        [(1, None), (2, 33), (3, 33), (3, 8), (4, 35)], "customer_id bigint, outcome_code int"
    )
    got = customer_calls(calls, RPC_CODES, AGREEMENT_CODES, 33)
    assert rows(got, "customer_id", "n_calls", "dialed", "rpc", "agreed") == [
        (1, 1, False, False, False),
        (2, 1, False, False, False),
        (3, 2, True, False, False),
        (4, 1, True, True, True),
    ]


def test_whole_last_day(random_tables):
    """The corrected window admits the last day's intraday payments."""
    window = a.DayWindow(date(1996, 5, 1), date(1996, 6, 15))
    settings = WHOLE.during(window)
    corrected = replace(settings, whole_last_day=True)
    total = "total_recovered_amount"
    published = sum(column(a.demographic_efficiency(random_tables, settings), total))
    whole = sum(column(a.demographic_efficiency(random_tables, corrected), total))
    assert published != whole


def test_score_lag_setting(random_tables):
    """Another month's scores regroup the same accounts and payments."""
    lagged = replace(WHOLE, score_lag_months=1)
    tiers = [
        {
            r.category: r.total_customers
            for r in a.score_efficiency(random_tables, settings, net=True).collect()
            if r.analysis_type == "By Predictive Score"
        }
        for settings in (WHOLE, lagged)
    ]
    assert tiers[0] != tiers[1]
    buckets = [
        [tuple(r) for r in a.score_efficiency(random_tables, settings, net=True).collect()][-7:]
        for settings in (WHOLE, lagged)
    ]
    assert buckets[0] == buckets[1]


def test_session_time_zone_does_not_matter(spark, random_tables):
    """Times without zone: no result depends on where the session runs."""
    analyses = [
        lambda: a.consolidated_efficiency(random_tables, WHOLE),
        lambda: a.kpis_by_month(random_tables, WHOLE),
        lambda: a.monthly_funnel(single_id(random_tables), FUNNEL),
    ]
    utc = [rows(analysis()) for analysis in analyses]
    spark.conf.set("spark.sql.session.timeZone", "America/Mexico_City")
    try:
        assert [rows(analysis()) for analysis in analyses] == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
