"""Physical plans over Parquet tables in the canonical schema, with broadcast
joins off so that the plan is the one large tables get."""

import re

import pytest
from pyspark.sql import functions as F

import arrearly as a
from arrearly import read_tables
from arrearly.sources.schemas import SCHEMAS
from arrearly.sources.tables import conform
from catalog.fixtures import FUNNEL, PIVOT, WHOLE, replace
from catalog.queries import BUILDERS

ANALYSES = {
    "assigned_by_month": lambda t: a.assigned_by_month(t, PIVOT),
    "covered_customers": lambda t: a.covered_customers(t, WHOLE),
    "score_efficiency": lambda t: a.score_efficiency(t, WHOLE),
    "demographic_efficiency": lambda t: a.demographic_efficiency(t, WHOLE),
    "consolidated_efficiency": lambda t: a.consolidated_efficiency(t, WHOLE),
    "monthly_funnel": lambda t: a.monthly_funnel(t, FUNNEL),
    "agreements_by_month": lambda t: a.agreements_by_month(t, PIVOT),
    "predictive_efficiency": lambda t: a.predictive_efficiency(t, WHOLE),
    "kpis_by_month": lambda t: a.kpis_by_month(t, WHOLE),
}
# Shuffles of each analysis. Two rank and re-key the portfolio, one each reduces
# exclusions, calls and (two) daily payments, one counts distinct customers, one
# merges the segments and one sorts the few result rows. The raw-id exclusion of
# assigned_by_month reuses the ranking's partitioning.
# No load_id among the loads, as in the published vocabularies: what is read of them.
KEYS = {"account_id", "load_ts", "past_due"}
USED = {
    "assigned_by_month": KEYS,
    "covered_customers": KEYS | {"balance"},
    "score_efficiency": KEYS | {"balance"},
    "demographic_efficiency": KEYS
    | {"balance", "birth_date", "saturation_pct", "last_contact_date", "reason_code"},
    "consolidated_efficiency": KEYS | {"balance", "birth_date", "income", "punctuality"},
    "monthly_funnel": KEYS | {"balance"},
    "agreements_by_month": KEYS | {"balance"},
    "predictive_efficiency": KEYS | {"balance", "birth_date", "income", "model_efficiency"},
    "kpis_by_month": KEYS | {"balance"},
}
# One row per segment goes through one task there, to number them.
ONE_TASK = {"p01b_order", "p02_order", "p04_order", "p05_order"}
SHUFFLES = {
    "assigned_by_month": 5,
    "covered_customers": 6,
    "score_efficiency": 10,
    "demographic_efficiency": 6,
    "consolidated_efficiency": 9,
    "monthly_funnel": 10,
    "agreements_by_month": 7,
    "predictive_efficiency": 9,
    "kpis_by_month": 9,
}


@pytest.fixture(scope="module")
def tables(spark, make_tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("canonical")
    source = make_tables(1)
    for table in SCHEMAS:
        getattr(source, table).write.parquet(str(folder / table))
    return read_tables(spark, {t: str(folder / t) for t in SCHEMAS})


@pytest.fixture(scope="module", autouse=True)
def large_tables(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.maxMetadataStringLength": "10000",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_blowup_no_python(tables, name):
    text = physical(ANALYSES[name](tables))
    for node in ("Expand", "CartesianProduct", "NestedLoop", "Python", "CollectLimit"):
        assert node not in text
    assert "LeftAnti" in text
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_shuffles(tables, name):
    text = physical(ANALYSES[name](tables))
    assert len(re.findall(r"(?<!Reused)Exchange ", text)) == SHUFFLES[name]


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_no_query_collects_a_group(tables, name):
    text = physical(BUILDERS[name](tables))
    for node in ("CartesianProduct", "NestedLoop", "collect_", "Python", "SinglePartition"):
        assert node not in text or (node == "SinglePartition" and name in ONE_TASK)


def scan(text, column):
    return next(line for line in text.splitlines() if "FileScan" in line and column in line)


@pytest.mark.parametrize("names", ["STAGING_NAMES", "CORE_NAMES", "DIRECTORY_NAMES"])
@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_no_other_column_is_read_without_load_id(tables, spark, tmp_path_factory, name, names):
    """Foreign columns and those that an analysis does not use stay in the file."""
    vocabulary = getattr(a, names)["portfolio"]
    path = _foreign_portfolio(tables, tmp_path_factory, names, vocabulary)
    loads = conform(spark.read.parquet(path), "portfolio", vocabulary)
    text = physical(ANALYSES[name](replace(tables, portfolio=loads)))
    source = {canonical: found for found, canonical in vocabulary.items()}
    found = next(x for x in text.splitlines() if "FileScan" in x and f"/{names}" in x)
    read = set(re.findall(r"(\w+):", found.split("ReadSchema: struct<")[1]))
    assert read == {source.get(c, c) for c in USED[name]}


def _foreign_portfolio(tables, tmp_path_factory, names, vocabulary):
    if names not in _WRITTEN:
        _WRITTEN[names] = str(tmp_path_factory.mktemp("foreign") / names)
        source = {canonical: found for found, canonical in vocabulary.items()}
        foreign = {f"foreign_{i}": F.lit(i) for i in range(3)}
        tables.portfolio.drop("load_id").withColumnsRenamed(source).withColumns(
            foreign
        ).write.parquet(_WRITTEN[names])
    return _WRITTEN[names]


_WRITTEN = {}


def test_filters_and_columns_reach_the_scan(tables):
    text = physical(a.consolidated_efficiency(tables, WHOLE))
    portfolio = scan(text, "load_id")
    for part in ("GreaterThan(account_id,0)", "GreaterThan(balance,0.00)", "load_ts,1995-01-01"):
        assert part in portfolio
    for unread in ("saturation_pct", "last_contact_date", "overdue_pct", "model_efficiency"):
        assert unread not in portfolio
    payments = scan(text, "payment_kind")
    assert "EqualTo(payment_kind,N)" in payments and "payment_ts,1995-01-01" in payments
    assert "agreement_score" not in scan(text, "contact_score")


def test_call_filters_pass_the_distinct(tables):
    text = physical(BUILDERS["contact_activity_monthly"](tables))
    calls = scan(text, "outcome_code")
    assert "EqualTo(kind,O)" in calls and "start_ts,1995-01-01" in calls
    # All columns are read: the DISTINCT compares whole rows.
    for column in SCHEMAS["interactions"].names:
        assert column in calls


def test_snapshot_is_computed_once(tables):
    """The scored and the unscored part of score_attach share one snapshot."""
    text = physical(BUILDERS["score_attach"](tables))
    assert text.count("WindowGroupLimit") == 2
    assert "ReusedExchange" in text
