import random

from llm import brute
import numpy as np
import pytest
from llm.llm_support import LONG, ODD, SF

from arrearly.llm import decontaminate, near_dup, queries
from arrearly.llm.common import ALNUM, NOT_SPACE, Words


def test_words_are_those_of_the_patterns():
    text = "Ab aB  ÉÉ-x9\x0b日本_é z. 12a A\x1cb"
    for classes, pattern in ((NOT_SPACE, brute.SPACE_WORD), (ALNUM, brute.ALNUM_WORD)):
        words = pattern.findall(brute.lower(text))
        h = Words(classes).hashes(text)
        assert len(h) == len(words)
        assert all((x == y) == (a == b) for x, a in zip(h, words) for y, b in zip(h, words))


def family(rng, n, words, rates):
    """Copies of one text in which each word is replaced with some probability."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [
        " ".join(w if rng.random() > rate else f"v{rng.randrange(10**6)}" for w in base)
        for rate in (rng.choice(rates) for _ in range(n))
    ]


@pytest.fixture(scope="module")
def near():
    """Families around the limit, exact copies, unrelated texts and odd ones."""
    rng = random.Random(11)
    texts = family(rng, 80, 120, [0.0, 0.01, 0.02, 0.03, 0.04, 0.06])
    texts += family(rng, 40, 40, [0.0, 0.02, 0.03])
    texts += [texts[0]] * 20 + [texts[3].upper()] + family(rng, 40, 100, [1.0])
    texts += ["", " ", "one two", "one two", "one two three"] + [LONG, LONG + "x"]
    rng.shuffle(texts)
    return {100 + i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [near_dup.BLOCK, 16])
def test_components_are_those_of_all_pairs(spark, near, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    df = spark.createDataFrame(list(near.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    want = brute.components(near)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_without_broadcast(spark, near, monkeypatch):
    monkeypatch.setattr(near_dup, "MAX_SENT_IDS", 0)
    df = spark.createDataFrame(list(near.items())[:80], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert found == {i: c for i, (_, c) in brute.components(dict(list(near.items())[:80])).items()}


def test_odd_texts(odd, empty):
    found = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()),
        key=repr,
    )
    sizes = [(i, len(brute.shingles(t))) for i, t in ODD]
    assert found == sorted(((i, n, i, True) for i, n in sizes), key=repr)
    assert near_dup.near_duplicates(empty).count() == 0


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for j in (0.95, 0.85, 0.75):
        n = 1000
        common = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (
            np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])
            for _ in range(2)
        )
        x, y = (near_dup.odd_sketch(near_dup.samples(s)) for s in (a, b))
        assert abs(near_dup.similarity(x, y) - j) < 0.1
        assert np.bitwise_count(x ^ y).sum() <= near_dup.most_ones()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (95, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in near_dup.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((90, 95, 100, 200), 90)


def test_near_dup_query(spark, texts):
    found = {r.doc_id: r for r in queries.op8_minhash_near_dedup(spark, SF).collect()}
    want = brute.components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == want


# --- benchmark ------------------------------------------------------------------


@pytest.mark.parametrize("sent", [decontaminate.MAX_SENT_SPANS, 0])
def test_hits_are_those_of_all_windows(spark, sent):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = {i: " ".join(word() for _ in range(rng.randrange(1, 30))) for i in range(12)}
    items |= {50: "a b, A-B a b a b a b a b", 51: "", 52: None, 53: items[3], 54: "the the " * 20}
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        if i % 3 == 0:
            w = items[rng.randrange(12)].split()
            at = rng.randrange(len(w))
            parts.append(" ".join(w[at : at + rng.choice((9, 10, 25))]))
        docs.append((i, ". ".join([*parts, " ".join(word() for _ in range(5))])))
    docs += ODD + [(90, "THE the " * 300), (91, "A B a b a b a b a b a b x")]
    df = spark.createDataFrame([(i, t, 5, ["z"]) for i, t in docs], "doc_id long, text string, n_hit long, item_ids array<string>")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.decontaminate(df, bench, max_sent_spans=sent).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in found]
    want = []
    for i, t in docs:
        n, hit, ids = brute.contamination(t, items)
        want.append((i, n, hit, ids, hit > 0))
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sent", [decontaminate.MAX_SENT_SPANS, 0])
def test_empty_sides(spark, odd, empty, sent):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(odd, bench, sent).collect()} == {0}
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, some, sent).count() == 0
