"""One query per operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearly.llm import (
    bpe,
    decontaminate,
    html_text,
    licenses,
    near_dup,
    ngram_lm,
    oracle,
    packing,
    pii,
    prefix_trie,
    pu_quality,
    quality_rules,
    repair,
    warc,
)
from arrearly.llm.common import documents, fold_of, shared_folder

# Whoever runs this on real data passes a secret of their own.
PII_KEY = "surrogates of the test tables"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    m = F.col("measures")
    base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return judged.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (F.col("kept") & ~base_failed).alias("kept"),
    )


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.vocabulary()
    encoded = bpe.encode(documents(spark, sf_dir), ranks, pattern)
    return bpe.decode(encoded, ranks, ids_digest=True).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages.select("page_id", "html")).select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY).select("doc_id", "text", "n_entities")


def op5_ngram_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = fold_of(F.col("doc_id"), 7) != 2
    docs = documents(spark, sf_dir).select("doc_id", "text", learned.alias("learned"))
    scored = ngram_lm.score_texts(docs, "learned")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("base", lambda d: d["start"])
    base = F.transform("base", lambda d: d["label"])
    every = F.concat(base, F.transform("licenses", lambda d: d["label"]))
    weights = F.concat(
        F.transform("base", lambda d: d["weight"]), F.transform("licenses", lambda d: d["weight"])
    )

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(every).alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_archives(warc.page_records(pages), path)
    stored = warc.read_archives(spark, path).where("record_type = 'response'")
    revisits = warc.read_archives(
        spark, path, "record_type string, record_id string, refers_to string, "
        "payload_digest string, payload_length string"
    ).where("record_type = 'revisit'")
    # A response is measured as it was read; a revisit has what its headers say.
    return stored.select(
        warc.page_id("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).union(
        revisits.select(
            warc.page_id("record_id"),
            F.col("payload_length").cast("long"),
            F.regexp_replace("payload_digest", "^sha1:", ""),
            "record_type",
            warc.page_id("refers_to"),
        )
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_pu_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = pu_quality.training_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fold = fold_of(F.col("doc_id"), pu_quality.FOLDS)
    held_out = F.coalesce(fold == pu_quality.HELD_OUT, F.lit(False))
    return pu_quality.classify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op11_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(documents(spark, sf_dir), vocabulary).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op12_block_table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = repair.damaged(conversations(spark, sf_dir))
    return repair.digested(messages, repair.reports(messages, times="times"), times="times")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(conversations(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_level_bpe": op2_byte_level_bpe,
    "op3_html_extraction": op3_html_extraction,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_ngram_lm_scoring": op5_ngram_lm_scoring,
    "op6_license_scan": op6_license_scan,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_pu_quality_classifier": op10_pu_quality_classifier,
    "op11_concat_and_cut": op11_concat_and_cut,
    "op12_block_table_repair": op12_block_table_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
