"""Benchmark decontamination by winnowing.

A fingerprint is the smallest of the k-gram hashes in a sliding window. Two
texts that share ``span`` words see the same window there and keep the same
k-gram, so fingerprints that meet are sure to find every shared span of that
length. Hits are extended to whole spans by the span hashes around them.

The fingerprints of a benchmark whose size is within a stated bound travel to
the documents, which are then read once and never shuffled. Beyond the bound
documents and items meet by a join on fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.llm.common import ALNUM, Words, appended, grams

SPAN = 10  # words of a shared span
GRAM = 5  # words of a fingerprint
# Spans of all items that may be sent to every worker: 12 bytes each.
MAX_SENT_SPANS = 4_000_000

RESULT = "n_words bigint, n_hit bigint, item_ids array<string>, contaminated boolean"


def winnowed(h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that some window of ``span`` words keeps."""
    g = grams(h, gram)
    per_window = span - gram + 1
    if len(g) < per_window:
        return np.empty(0, dtype=np.int64), g[:0]
    views = np.lib.stride_tricks.sliding_window_view(g, per_window)
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return at, g[at]


def _grams_at(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return grams(h[starts[:, None] + np.arange(n)].T, n)[0] if len(starts) else h[:0]


def _found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


@dataclass
class Spans:
    """The spans of benchmark items by length, as sorted hashes with item numbers.

    An item shorter than ``span`` words is one span of its own length. Winnowing
    says nothing about those, so their hashes are looked up at every word.
    """

    fingerprints: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[np.ndarray], span: int = SPAN, gram: int = GRAM) -> Spans:
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        kept = []
        for number, h in enumerate(items):
            if len(h):
                n = min(span, len(h))
                found.setdefault(n, []).append((np.unique(grams(h, n)), number))
                kept.append(winnowed(h, span, gram)[1])
        by_length = {}
        for n, parts in found.items():
            hashes = np.concatenate([x for x, _ in parts])
            owner = np.concatenate([np.full(len(x), i, dtype=np.int32) for x, i in parts])
            order = np.argsort(hashes, kind="stable")
            by_length[n] = (hashes[order], owner[order])
        prints = np.unique(np.concatenate(kept)) if kept else np.empty(0, dtype=np.uint64)
        return cls(prints, by_length)

    def hits(self, h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, set[int]]:
        """The words of a text inside any item span, and the items concerned."""
        edges = np.zeros(len(h) + 1, dtype=np.int64)
        items: set[int] = set()
        for n, (table, owner) in self.by_length.items():
            if len(h) < n:
                continue
            if n == span:
                at, prints = winnowed(h, span, gram)
                at = at[_found(prints, self.fingerprints)]
                near = (at[:, None] - np.arange(span - gram + 1)).ravel()
                starts = np.unique(near[(near >= 0) & (near <= len(h) - n)])
            else:
                starts = np.arange(len(h) - n + 1)
            if not len(starts):
                continue
            value = _grams_at(h, starts, n)
            is_hit = _found(value, table)
            starts, value = starts[is_hit], np.unique(value[is_hit])
            edges[starts] += 1
            np.subtract.at(edges, starts + n, 1)
            for a, b in zip(np.searchsorted(table, value), np.searchsorted(table, value, "right")):
                items.update(owner[a:b].tolist())
        return np.cumsum(edges[:-1]) > 0, items


def _item_hashes(texts: list[str | None]) -> list[np.ndarray]:
    reader = Words(ALNUM)
    return [reader.hashes(x) for x in texts]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    max_sent_spans: int = MAX_SENT_SPANS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with the words that lie in any ten-word window of a benchmark item.

    Adds ``n_words``, ``n_hit``, ``item_ids`` (sorted texts of the ids whose
    windows occur) and ``contaminated``; columns of these names are replaced.
    NULL and empty texts have no words and no hits. An item without words never
    occurs; items of equal text all count; a NULL item id is listed as ''.
    Repeated rows get equal results; an empty benchmark hits nothing.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.col(item_text).alias("item_text"),
    )
    # A text of n bytes has at most (n + 1) / 2 words and so as many spans.
    size = items.select(F.sum((F.octet_length("item_text") + 1) / 2)).first()[0] or 0
    if size <= max_sent_spans:
        return _by_sent_spans(docs, items, text)
    return _by_join(docs, items, text)


def _by_sent_spans(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    rows = items.where("item_text IS NOT NULL").collect()  # bounded by max_sent_spans
    names = np.array([r["item"] for r in rows], dtype=object)
    sent = docs.sparkSession.sparkContext.broadcast(
        Spans.of(_item_hashes([r["item_text"] for r in rows]))
    )
    column = docs.drop(*_names()).columns.index(text)

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        reader, spans, out = Words(ALNUM), sent.value, []
        for h in reader.each(batch.column(column)):
            hit, found = spans.hits(h)
            out.append((len(h), int(hit.sum()), sorted({str(names[i]) for i in found})))
        n_words, n_hit, ids = zip(*out) if out else ((), (), ())
        return [
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(ids, pa.list_(pa.string())),
            pa.array([n > 0 for n in n_hit], pa.bool_()),
        ]

    return appended(docs, RESULT, judge)


def _names() -> list[str]:
    return ["n_words", "n_hit", "item_ids", "contaminated"]


def _by_join(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """For a benchmark of any size: one row per fingerprint on either side.

    Results belong to a text, so they are keyed by its digest: copies are
    matched once, and neither NULL nor repeated ids matter. Fingerprints that
    many texts share make a hot key of an inner join, which adaptive execution
    can split.
    """
    digest = F.sha2(F.col(text), 256)
    texts = docs.select(digest.alias("digest"), F.col(text).alias("doc_text")).where(
        "doc_text IS NOT NULL"
    )
    items = items.where("item_text IS NOT NULL")
    short = (
        items.select("item", "item_text").mapInArrow(_lengths, "n int").distinct().collect()
    )  # at most SPAN rows
    lengths = sorted(r["n"] for r in short if 0 < r["n"] < SPAN)

    def prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words(ALNUM)
        for batch in it:
            for key, h in zip(batch.column(0), reader.each(batch.column(1))):
                sizes = lengths if batch.schema.names[0] == "digest" else {len(h)} & set(lengths)
                parts = [winnowed(h)[1]] + [grams(h, n) for n in sizes]
                found = np.unique(np.concatenate(parts)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(found), pa.string()), pa.array(found)],
                    names=[batch.schema.names[0], "fingerprint"],
                )

    doc_prints = texts.mapInArrow(prints, "digest string, fingerprint bigint").distinct()
    item_key = F.sha2(F.concat_ws("\x00", "item", "item_text"), 256)
    keyed_items = items.withColumn("item_key", item_key).dropDuplicates(["item_key"])
    item_prints = (
        keyed_items.select("item_key", "item_text")
        .mapInArrow(prints, "item_key string, fingerprint bigint")
    )
    pairs = doc_prints.join(item_prints, "fingerprint").select("digest", "item_key").distinct()

    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words(ALNUM)
        for batch in it:
            out = []
            for key, doc, item, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                hit, found = Spans.of([reader.hashes(item_text)]).hits(reader.hashes(doc))
                out += [(key, item, np.flatnonzero(hit).tolist())] if found else []
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("digest", "item", "at"), x)) for x in out],
                schema=pa.schema(
                    {"digest": pa.string(), "item": pa.string(), "at": pa.list_(pa.int64())}
                ),
            )

    hits = (
        texts.dropDuplicates(["digest"])
        .join(pairs, "digest")
        .join(keyed_items, "item_key")
        .select("digest", "doc_text", "item", "item_text")
        .mapInArrow(extend, "digest string, item string, at array<bigint>")
    )
    per_text = hits.groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    words_hit = (
        hits.select("digest", F.explode("at").alias("at")).distinct().groupBy("digest").count()
    )
    found = per_text.join(words_hit, "digest").withColumnRenamed("count", "n_hit")

    def count_words(batch: pa.RecordBatch) -> list[pa.Array]:
        reader = Words(ALNUM)
        return [pa.array([len(h) for h in reader.each(batch.column(column))], pa.int64())]

    docs = docs.drop(*_names())
    column = docs.columns.index(text)
    return (
        appended(docs, "n_words bigint", count_words)
        .withColumn("digest", digest)
        .join(found, "digest", "left")
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def _lengths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each item, at most SPAN."""
    reader = Words(ALNUM)
    for batch in it:
        n = [min(SPAN, len(h)) for h in reader.each(batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32())], names=["n"])
