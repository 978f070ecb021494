import zlib

import numpy as np
import pytest
from llm.llm_support import ODD, SF

from arrearly.llm import pu_quality, queries


def test_non_negative_risk_separates():
    """Positives and a mixture of them with negatives, told apart without negatives."""
    rng = np.random.default_rng(1)
    n, k = 2000, pu_quality.N_FEATURES
    positives = rng.normal(0, 1, (n, k))
    hidden = rng.random(n) < 0.7
    unlabelled = rng.normal(0, 1, (n, k)) + np.where(hidden, 0, 3)[:, None] * (np.arange(k) < 5)
    model = pu_quality.fit(positives, unlabelled)
    assert model.prior == pytest.approx(0.7, abs=0.06)
    accepted = model.score(unlabelled) >= 0.5
    assert (accepted == hidden).mean() > 0.95


def test_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = pu_quality.training_model(odd, labels)
    found = pu_quality.classify(odd, model).collect()
    assert len(found) == len(ODD)
    assert {(r.score, r.predicted) for r in found} == {(0.5, 0)}
    assert pu_quality.classify(empty, model).count() == 0
    assert pu_quality.training_model(empty, labels).parts == []


def test_odd_texts_have_scores(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pu_quality.training_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    found = pu_quality.classify(odd, model)
    assert set(found.columns) == {*odd.columns, "predicted"}
    rows = found.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    # Whatever repeats has one score; NULL is as empty.
    assert len({r.score for r in rows if r.text == "one"}) == 1
    assert len({r.score for r in rows if r.text in (None, "")}) == 1


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"
    flipped = labels.selectExpr(
        "doc_id", f"CASE WHEN {held} THEN 1 - quality ELSE quality END AS quality", "toxic"
    )
    a, b = (pu_quality.training_model(docs, x) for x in (labels, flipped))
    assert all((x == y).all() for x, y in zip(a.parts, b.parts))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op10_pu_quality_classifier(spark, sf).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(r.predicted == int(r.score >= 0.7) for r in found)
    right = [r.predicted == quality[r.doc_id] for r in found if r.held_out and r.doc_id in quality]
    assert len(right) > 500 and np.mean(right) > 0.98
