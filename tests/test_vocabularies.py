"""The analyses over tables in each source vocabulary."""

import pytest

import arrearly as a
from arrearly.sources.schemas import SCHEMAS
from catalog.fixtures import FUNNEL, WHOLE, single_id
from support import rows

CASES = {
    "staging": (
        a.STAGING_NAMES,
        lambda t: t,
        [
            lambda t: a.assigned_by_month(t, WHOLE),
            lambda t: a.covered_customers(t, WHOLE),
            lambda t: a.score_efficiency(t, WHOLE),
            lambda t: a.demographic_efficiency(t, WHOLE),
            lambda t: a.consolidated_efficiency(t, WHOLE),
        ],
    ),
    "core": (a.CORE_NAMES, single_id, [lambda t: a.monthly_funnel(t, FUNNEL)]),
    "directory": (
        a.DIRECTORY_NAMES,
        lambda t: t,
        [
            lambda t: a.agreements_by_month(t, WHOLE),
            lambda t: a.predictive_efficiency(t, WHOLE),
        ],
    ),
}
# Columns that the vocabularies name as the canonical schema does.
KEPT = {
    "portfolio": ["load_id"],
    "interactions": ["agent_id", "term_weeks"],
    "scores": [
        "customer_id", "cutoff_date", "contact_score", "agreement_score", "payment_score",
        "general_score",
    ],
    "payments": ["customer_id", "amount"],
    "third_party": ["customer_id"],
    "exposure": SCHEMAS["exposure"].names,
}


@pytest.mark.parametrize("vocabulary", sorted(CASES))
def test_vocabulary(spark, random_tables, tmp_path, vocabulary):
    names, adapt, analyses = CASES[vocabulary]
    tables = adapt(random_tables)
    locations = {}
    for table, renames in names.items():
        df = getattr(tables, table)
        back = {canonical: source for source, canonical in renames.items()}
        known = [c for c in df.columns if c in back or c in KEPT[table]]
        locations[table] = str(tmp_path / table)
        df.select(known).withColumnsRenamed(back).write.parquet(locations[table])
    read = a.read_tables(spark, locations, names)
    for analysis in analyses:
        found = rows(analysis(read))
        assert found == rows(analysis(tables))
        assert found
