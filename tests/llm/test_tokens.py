import hashlib
import random
import zlib

from llm import brute
import numpy as np
import pytest
import regex
import tiktoken
from llm.llm_support import LONG, ODD, SF
from pyspark.sql import functions as F

from arrearly.llm import blocks, bpe, ngram_lm, queries


@pytest.fixture(scope="session")
def vocabulary():
    ranks, pattern = bpe.vocabulary()
    return ranks, pattern, tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def test_merges(vocabulary):
    ranks, pattern, library = vocabulary
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("abthe ionéüß日\t\n1! \x1c") for _ in range(rng.randrange(80)))
        pieces = regex.findall(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), text)
        ids = [i for p in pieces for i in bpe.merged(p.encode(), ranks)]
        assert [i for p in pieces for i in library._encode_single_piece(p)] == ids


def test_encode_and_decode(spark, odd, vocabulary):
    ranks, pattern, library = vocabulary
    encoded = bpe.encode(odd, ranks, pattern, ["doc_id", "kept"])
    assert encoded.columns == ["doc_id", "kept", "n_tokens", "ids"]
    got = [(r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.decode(encoded, ranks).collect()]
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_texts(empty, vocabulary):
    ranks, pattern, _ = vocabulary
    encoded = bpe.encode(empty, ranks, pattern)
    assert bpe.decode(encoded, ranks).count() == 0
    with pytest.raises(ValueError, match="single byte"):
        bpe.encode(empty, {b"a": 0}, pattern)


def test_bpe_query(spark, texts, vocabulary):
    library = vocabulary[2]
    found = queries.op2_byte_level_bpe(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_packing():
    rng = np.random.default_rng(1)
    for high in (1, 200, 300, 70_000, 2**32 - 1):
        x = rng.integers(0, high, 1000, endpoint=True)
        assert (blocks.unpack_codes(blocks.pack_codes(x)) == x).all()
        assert (blocks.unpack_numbers(blocks.pack_numbers(x, 8), 8) == x).all()
    words = [b"", b"a", "ß\n".encode() * 50]
    assert blocks.unpack_words(blocks.pack_words(words)) == words
    assert blocks.unpack_words(blocks.pack_words([])) == []
    runs = blocks.ragged(np.arange(10), np.array([3, 0, 7]), np.array([2, 0, 3]))
    assert runs.tolist() == [3, 4, 7, 8, 9]


# --- language model -------------------------------------------------------------


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def check_scores(found, texts, learned, rate):
    training = [tokens(t) for i, t in texts if learned(i)]
    model = brute.BackoffModel(training, rate)
    got = sorted(found, key=lambda r: repr((r.doc_id, r.n_tokens, r.base_score)))
    want = []
    for i, t in texts:
        w = tokens(t)
        base = sum(np.log10(model.unigram(x)) for x in w)
        want.append((i, len(w), sum(model.counts[x] > 0 for x in w), float(base), model.score(w)))
    want.sort(key=lambda x: repr((x[0], x[1], x[3])))
    assert len(got) == len(want)
    for r, (i, n, known, base, score) in zip(got, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, n, known, model.total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)
    return model


def test_scores_of_odd_texts(odd):
    short = odd.where(F.col("text").isNull() | (F.length("text") < 1000))
    learned = short.withColumn("learned", F.col("doc_id") % 2 == 1)
    found = ngram_lm.score_texts(learned, "learned", rate=0.05).collect()
    rows = [(i, t) for i, t in ODD if t != LONG]
    model = check_scores(found, rows, lambda i: i is not None and i % 2 == 1, 0.05)
    for context in [(), (b"a",), (b"a", b"b")]:
        total = sum(model.p(context, w) for w in model.counts) + model.p(context, b"unseen")
        assert total == pytest.approx(1)


def test_nothing_to_learn_from(odd, empty):
    found = ngram_lm.score_texts(odd.withColumn("learned", F.lit(False)), "learned").collect()
    assert len(found) == len(ODD)
    assert {(r.n_known, r.train_tokens, r.score) for r in found} == {(0, 0, 0.0)}
    assert ngram_lm.score_texts(empty.withColumn("learned", F.lit(True)), "learned").count() == 0


def test_lm_query(spark, texts):
    found = queries.op5_ngram_lm_scoring(spark, SF).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    assert {r.doc_id: r.held_out for r in found} == held
    check_scores(found, list(texts.items()), lambda i: not held[i], ngram_lm.RATE)
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
