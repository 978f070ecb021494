"""The stages against brute force, each on its own input, as the pipeline runs them."""

from llm import brute
import pytest
from llm.llm_support import SF
from pyspark.sql import functions as F

import corpus_pipeline
from arrearly.llm import bpe, pii, pu_quality
from arrearly.llm.common import written


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = pu_quality.training_model(stages[0], labels)
    judged = pu_quality.classify(stages[0], model)
    assert by_id(stages[1]).keys() == by_id(judged.where("predicted = 1")).keys()
    good = by_id(labels.where("quality = 1")).keys()
    assert len(good - by_id(stages[1]).keys()) <= 0.03 * len(good)


def test_near_dedup(stages):
    texts = {i: r.text for i, r in by_id(stages[1]).items()}
    want = {i for i, (_, c) in brute.components(texts).items() if c == i}
    assert by_id(stages[2]).keys() == want


def test_decontamination(spark, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {i for i, r in by_id(stages[2]).items() if not brute.contamination(r.text, items)[1]}
    assert by_id(stages[3]).keys() == want


def test_surrogates(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    marked = by_id(pii.pseudonymize(stages[3], corpus_pipeline.PII_KEY))
    for i, r in after.items():
        assert (r.text != before[i].text) == (marked[i].n_entities > 0)
        assert r.n_chars == len(r.text) and r.lang == before[i].lang


def test_tokens(stages):
    before, after = by_id(stages[4]), by_id(stages[5])
    assert before.keys() == after.keys()
    ranks, _ = bpe.vocabulary()
    token = {i: t for t, i in ranks.items()}
    for i, r in after.items():
        assert r.text == before[i].text and r.n_tokens == len(r.ids)
        assert b"".join(map(token.__getitem__, r.ids)).decode() == r.text


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF).select("doc_id", F.xxhash64("ids").alias("h"))
    assert by_id(found) == by_id(stages[5].select("doc_id", F.xxhash64("ids").alias("h")))


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0


EXTRA = ["n_tokens", "counted", "score", "predicted", "n_words", "n_hit", "item_ids", "contaminated",
         "n_entities", "digest", "tag", "rest", "my col", "a`b", "component_id", "kept", "block"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_extra_columns_come_through(spark, stage):
    """Columns with the names of results, spaces and quotes, and a nested one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    marks = {c: F.concat_ws("/", F.lit(c), "doc_id") for c in EXTRA}
    wide = docs.withColumns(marks).withColumn("nested", F.struct(F.array("lang").alias("x y")))
    out = stage(spark, wide, SF)
    last = stage is corpus_pipeline.tokens
    names = [c for c in wide.columns if not (last and c in ("n_tokens", "text"))]
    assert [c for c in out.columns if c in names] == names
    rows = out.collect()
    assert rows
    for r in rows:
        for c in EXTRA:
            assert r[c] == (len(r["ids"]) if last and c == "n_tokens" else f"{c}/{r.doc_id}")
        assert r.nested[0] == [r.lang]


LONG_A = "alpha beta gamma delta " + " ".join(f"w{i}" for i in range(60))
OTHER = "quite another text of many words " + " ".join(f"z{i}" for i in range(60))


def test_near_dedup_of_repeated_ids(spark):
    rows = [(1, LONG_A), (1, LONG_A), (2, LONG_A), (2, OTHER), (None, LONG_A), (None, LONG_A),
            (3, None), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [(1, LONG_A), (2, OTHER), *rows[4:]]
    assert found == sorted(want, key=repr)


def test_near_copies_of_one_id(spark):
    """Two near copies with the same smallest id: one of them stays."""
    near = LONG_A + " tail"
    docs = spark.createDataFrame([(1, LONG_A), (1, near), (5, LONG_A)], "doc_id long, text string")
    out = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert len(out) == 1 and out[0].doc_id == 1 and out[0].text in (LONG_A, near)


def test_null_ids_and_texts_reach_the_end(spark):
    rows = [(None, LONG_A), (7, None), (8, ""), (None, None), (9, OTHER), (9, OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF))
    found = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    want = [(i, t or "") for i, t in rows[:5]]
    assert found == sorted(want, key=repr)
