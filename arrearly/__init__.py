"""Loan-portfolio recovery analytics as PySpark DataFrame plans."""

from arrearly.params import CORE, DIRECTORY, STAGING, DayWindow, Settings, rolling_months
from arrearly.plans.efficiency import (
    consolidated_efficiency,
    demographic_efficiency,
    predictive_efficiency,
    score_efficiency,
)
from arrearly.plans.funnel import funnel_counts, kpis_by_month, monthly_funnel, rolling_kpis
from arrearly.plans.pivots import agreements_by_month, assigned_by_month, covered_customers
from arrearly.plans.states import kpi_states, rolling_kpis_from_states, span_kpis, write_states
from arrearly.sources.layout import read_months, write_months
from arrearly.sources.schemas import CORE_NAMES, DIRECTORY_NAMES, STAGING_NAMES
from arrearly.sources.tables import Tables, read_tables

__all__ = [
    "CORE",
    "CORE_NAMES",
    "DIRECTORY",
    "DIRECTORY_NAMES",
    "STAGING",
    "STAGING_NAMES",
    "DayWindow",
    "Settings",
    "Tables",
    "agreements_by_month",
    "assigned_by_month",
    "consolidated_efficiency",
    "covered_customers",
    "demographic_efficiency",
    "funnel_counts",
    "kpi_states",
    "kpis_by_month",
    "monthly_funnel",
    "predictive_efficiency",
    "read_months",
    "read_tables",
    "rolling_kpis",
    "rolling_kpis_from_states",
    "rolling_months",
    "score_efficiency",
    "span_kpis",
    "write_months",
    "write_states",
]
