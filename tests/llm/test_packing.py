"""Packing against a tokenizer run over whole texts, and the rules of its pieces."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.llm_support import SF
from tokenizers import Tokenizer

from arrearly.llm import packing, queries

VOCABULARY = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_str(VOCABULARY)
    out.encode_special_tokens = True
    return out


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def assert_packed(pieces, want, window=packing.WINDOW):
    """``pieces`` are (document, start, length, crc, doc_tokens, sequence, offset) and
    hold the ids of ``want`` {document: ids}, gapless on both sides."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p[1:5])
        by_sequence[p[5]].append((p[6], p[2]))
    assert by_doc.keys() == want.keys()
    for doc, ids in want.items():
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            part = np.array(ids[start : start + length], "<u4").tobytes()
            assert (start, crc, total) == (at, zlib.crc32(part), len(ids)) and length > 0
            at += length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)  # nothing is padded


def test_query(spark, texts, tokenizer):
    found = queries.QUERIES["op11_concat_and_cut"](spark, SF)
    assert_packed(map(tuple, found.collect()), {i: whole(tokenizer, t) for i, t in texts.items()})


def test_odd_texts(odd, tokenizer):
    """NULL and empty texts, repeated rows and NULL ids, a long text, a small window."""
    rows = odd.select("doc_id", "text").collect()
    pieces = packing.pack(odd.repartition(3), VOCABULARY, window=64).collect()
    want = sorted((len(whole(tokenizer, r.text)) for r in rows), reverse=True)
    starts = [p.doc_tokens for p in pieces if p.start == 0]
    assert sorted(starts, reverse=True) == want
    assert sum(p.length for p in pieces) == sum(want)
    joined = {p.sequence_id: 0 for p in pieces}
    for p in pieces:
        joined[p.sequence_id] += p.length
    assert all(n == 64 or n & (n - 1) == 0 for n in joined.values())


def test_clashing_columns(spark, odd, empty):
    named = odd.selectExpr("doc_id", "text", "'x' AS `my col`", "1 AS start", "2 AS ids", "3 AS task")
    out = packing.pack(named, VOCABULARY, kept=["doc_id", "my col", "start", "ids", "task"])
    assert out.columns == [
        "doc_id", "my col", "task", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    ]
    assert {(r["my col"], r.task) for r in out.collect()} == {("x", 3)}
    assert packing.pack(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("tokens", [1, 63, 64, 65, 127, 128, 200])
def test_tail(spark, tokens):
    """One document whose length falls on, before and after the end of a window."""
    docs = spark.createDataFrame([(7, "a " * (tokens - 1))], "doc_id long, text string")
    pieces = packing.pack(docs, VOCABULARY, window=64).collect()
    assert sum(p.length for p in pieces) == tokens
    assert {p.doc_tokens for p in pieces} == {tokens}
    rest = tokens % 64
    assert len(pieces) == tokens // 64 + rest.bit_count()


def test_sequences(spark, texts, tokenizer):
    docs = spark.createDataFrame([(7, "b " * 99), (8, None), (9, "c " * 70)], "doc_id long, text string")
    pieces = packing.pack(docs, VOCABULARY, window=64)
    made = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    for p in pieces.collect():
        assert made[p.sequence_id].ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids
    assert all(len(r.ids) == 4 * r.n_tokens and r.padded_to == r.n_tokens for r in made.values())
    # A sequence that is no power of two is padded.
    alone = packing.sequences(pieces.where("doc_id = 9"), 64).collect()
    assert {r.padded_to for r in alone if r.n_tokens & (r.n_tokens - 1)} <= {64}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZé ß1'\t\n\r ́　ΣσI日.!<|s")), max_size=30), max_size=5))
def test_words_give_the_ids_of_whole_texts(tokenizer, texts):
    encoder = packing.WordIds(VOCABULARY)
    ids, sizes = encoder.of([t.encode() for t in texts], packing.END)
    want = [whole(tokenizer, t) for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(want)] == want or not texts


def test_vocabulary_with_white_space_gets_whole_texts():
    other = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    tok = Tokenizer.from_str(other)
    tok.encode_special_tokens = True
    texts = ["two  words\n\n and", "", " x"]
    ids, sizes = packing.WordIds(other).of([t.encode() for t in texts], 0)
    want = [[*tok.encode(t).ids, 0] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
