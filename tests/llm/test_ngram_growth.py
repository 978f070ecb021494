import time

from pyspark.sql import functions as F
from test_tokens import check_scores

from arrearly.llm import blocks, common, ngram_lm


def test_rare_ngrams_keep_their_arcs_in_a_large_corpus(spark):
    """300,000 training tokens: a share of 1e-5 of them would drop what occurs once or twice."""
    rows = [(i, " ".join(f"w{(i * 37 + k * k) % 900}" for k in range(299))) for i in range(1000)]
    rows += [(2000, "rare blue whale"), (2002, "rare blue whale song"), (2001, "a rare blue whale song")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_lm.score_texts(df.withColumn("learned", F.col("doc_id") != 2001), "learned").collect()
    model = check_scores(found, rows, lambda i: i != 2001, 0.0)
    assert model.total > 300_000 and (b"rare", b"blue", b"whale") in model.kept[3]
    by_id = {r.doc_id: r for r in found}
    assert by_id[2001].score > by_id[2001].base_score + 9


def _states_asked(table, words):
    """The words whose sums blocks ask for, and the rows of pairs that are counted."""
    setup = ngram_lm._Setup(1.0, 8 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3)
    pairs = ngram_lm._count_ngrams(table, words, 2, setup)
    asked = pairs.where(F.col("kind") == ngram_lm.ASKED).select("a").collect()
    return sum(len(ngram_lm._unpack_sorted(bytes(r.a))) for r in asked), pairs


def test_only_states_of_unseen_ngrams_are_asked_for(spark):
    """What the block's own training texts hold has an arc, so no failure arc is taken there."""
    for unseen, states in [("a b c", 0), ("a c a", 2), ("z", 1)]:
        rows = [(1, "a b c", True), (2, "b c d", True), (3, unseen, unseen == "a b c")]
        df = spark.createDataFrame(rows, "doc_id long, text string, learned boolean").coalesce(1)
        table = blocks.blocks(df, ["doc_id"], ngram_lm._words, "text", "learned")
        assert _states_asked(table, ngram_lm._count_words(table))[0] == states


def test_no_more_buckets_than_the_texts_fill(spark):
    """With 211 partitions a few texts made 422 x 422 rows of sums."""
    made = []
    df = spark.createDataFrame([(1, "a b c a b d", True)], "doc_id long, text string, learned boolean")
    before, count = spark.conf.get("spark.sql.shuffle.partitions"), ngram_lm._count_ngrams
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        ngram_lm._count_ngrams = lambda *a: made.append(count(*a)) or made[-1]
        ngram_lm.score_texts(df, "learned")
        assert [x.where(F.col("kind") == ngram_lm.SUMS).count() for x in made] == [1, 1]
    finally:
        ngram_lm._count_ngrams = count
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffle_files_go_when_the_table_stands(spark):
    def files():
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size())}

    before = files()
    rows = common.written(spark.range(1000).repartition(3, "id"), free=True)
    for _ in range(100):
        if not (left := {f for f in files() - before if f.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    assert rows.count() == 1000 and not left
