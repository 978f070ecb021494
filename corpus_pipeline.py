"""From raw documents to token ids, in five stages.

Every stage takes what the one before it kept and returns documents again; the
last returns them as ids. Nothing is sampled or cut: a stage sees whole texts.

All stages treat odd rows alike. Rows with a NULL or repeated doc_id are documents like
others; a NULL text is one without words; an empty table stays empty. Columns beside
doc_id and text come through as they are, whatever their names and types, because
the operators see them as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearly.llm import bpe, decontaminate, near_dup, pii, pu_quality
from arrearly.llm.common import documents, written
from arrearly.llm.queries import PII_KEY

# Blocks of the last stage: its workers follow those of four others on the same executors.
BLOCK_TOKENS = 400_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, ``rest``, with numbered fields."""
    fields = [_column(c).alias(f"c{i}") for i, c in enumerate(_others(docs))]
    rest = F.struct(*fields or [F.lit(0).alias("c0")])
    return docs.select("doc_id", "text", rest.alias("rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs``, in their order, from a packed table."""
    place = {c: i for i, c in enumerate(_others(docs))}
    return [
        packed["rest"][f"c{place[c]}"].alias(c) if c in place else packed[c]
        for c in docs.columns
        if c not in but
    ]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    A text without words is scored as an empty one; equal texts have equal scores. Labels
    belong to ids, so rows without an id teach nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed = _packed(docs)
    model = pu_quality.training_model(packed, labels)
    accepted = pu_quality.classify(packed, model).where("predicted = 1")
    return accepted.select(*_unpacked(accepted, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of near-duplicates with one id the text with the smallest hash stays, of equal
    texts with one id one row. Rows without an id or without words all stay.
    """
    tagged = _packed(docs).withColumn("tag", F.xxhash64("text"))
    judged = written(
        near_dup.near_duplicates(tagged, tag="tag").where("doc_id IS NOT NULL AND n_shingles > 0")
    )
    key = ["doc_id", "tag"]
    # Where an id has several texts that are kept, they are all of its own group.
    first = judged.where("kept").groupBy("doc_id").agg(
        F.min("tag").alias("least"), F.max("tag").alias("most")
    ).where("least <> most")
    second = judged.where("kept").join(first, "doc_id").where("tag <> least")
    dropped = written(judged.where("NOT kept").select(key).union(second.select(key)).distinct())
    # Small enough, the ids go to the documents; else both sides are shuffled.
    kept = tagged.join(_sent_if_few(dropped), key, "left_anti")
    again = written(judged.groupBy(key).count().where("count > 1").select(key))
    if not again.isEmpty():
        again = _sent_if_few(again)
        once = kept.join(again, key, "left_semi").dropDuplicates(key)
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept.select(*_unpacked(kept, docs))


def _sent_if_few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= near_dup.MAX_SENT_IDS else keys


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.decontaminate(_packed(docs), benchmark).where("NOT contaminated")
    return clean.select(*_unpacked(clean, docs))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars``, where there is one, follows."""
    out = pii.pseudonymize(_packed(docs), PII_KEY)
    out = out.select(*_unpacked(out, docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as ids, with the text that the ids decode to.

    A NULL text is an empty one. Columns named ``n_tokens`` or ``ids`` give way to the results.
    """
    ranks, pattern = bpe.vocabulary()
    found = bpe.encode(
        _packed(docs), ranks, pattern, ["doc_id", "rest"], decoded=True, block_tokens=BLOCK_TOKENS
    )
    text = F.col("decoded").cast("string").alias("text")
    return found.select(
        *_unpacked(found, docs, ("text", "n_tokens", "ids")), text, "n_tokens", "ids"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII surrogates", surrogates),
    ("byte-level BPE", tokens),
]

# A model, similarities and token merges are beyond SQL: tests/llm checks the
# rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
