from __future__ import annotations

import pytest
from llm.llm_support import ODD, SF


@pytest.fixture(scope="session")
def odd(spark):
    """Texts with a column that clashes with every operator's results."""
    clash = "n_words long, kept boolean, score double, contaminated boolean, component_id long"
    return spark.createDataFrame(
        [(i, t, 99, False, 9.0, True, -1) for i, t in ODD], f"doc_id long, text string, {clash}"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}
