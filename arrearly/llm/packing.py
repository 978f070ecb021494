"""Concatenate and cut: all documents in one stream of tokens, cut into sequences.

Pass 1 turns texts into ids, task by task, and gives every document the number of
tokens that its task had before it. The tokens per task are added up, which gives
every task its place in the stream, and so every document its global offset. Pass 2
cuts the documents where a fixed window ends; the two records on either side of a cut
say where they begin in their document and in their sequence. No ids are shuffled, and
no key decides where a row is worked on, so no source and no group of copies is hot.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from arrearly.llm.blocks import ragged
from arrearly.llm.common import shared_folder

WINDOW = 4096
END = 2
#: Bytes of text whose ids are made together, and words whose ids a worker remembers.
_BYTES, _REMEMBERED = 1 << 22, 600_000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class WordIds:
    """Ids of texts, every word encoded once.

    The vocabulary's pattern never matches across white space, which it drops, nor across
    the edge of a lower-case ASCII letter and one of ``.,;:!?``, and it ignores
    case; so a text's ids are those of its words between such edges, in order. A vocabulary
    that does otherwise with a probe gets whole texts.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        self._tokenizer = Tokenizer.from_str(vocabulary)
        # The strings of special tokens are ordinary text in a document.
        self._tokenizer.encode_special_tokens = True
        probe = ["Ab's. \t\n\rcd,e!?f;:g ", "ab's", ".", "cd", ",", "e", "!?", "f", ";:", "g"]
        whole, *parts = self._ids(probe)
        self._by_word = whole == [i for x in parts for i in x]
        self._known: dict[str, bytes] = {}
        # Ids that end a word, if the vocabulary marks them.
        mark = json.loads(vocabulary)["model"].get("end_of_word_suffix") if self._by_word else None
        ids = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(ids.values(), default=0) + 1, dtype=bool)
        self._ends[[i for token, i in ids.items() if mark and token.endswith(mark)]] = True

    def _ids(self, words: list[str]) -> list[list[int]]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [x.ids for x in found]

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that have ids, where words begin in them (and the last ends), and where
        texts end."""
        if not self._by_word:
            return data, np.unique(ends), ends
        lower = _LOWER[data]
        kept = ~_WHITE[data]
        letter, stop = _LETTER[lower], _STOP[lower]
        new = np.zeros(len(data) + 1, dtype=bool)
        new[ends] = True
        new[1:-1] |= (kept[1:] != kept[:-1]) | (letter[1:] & stop[:-1]) | (stop[1:] & letter[:-1])
        place = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kept, out=place[1:])
        edges = place[np.flatnonzero(new)]  # ascending, equal where only white space lies between
        return lower[kept], edges[np.append(True, edges[1:] != edges[:-1])], place[ends]

    def _learn(self, new: list[str]) -> None:
        """The ids of new words. Words of plain letters are one match of the pattern each and
        so end with one marked id: they are encoded by the line, which takes half the time."""
        plain = [w for w in new if w.isalpha() and max(w) < "\u0250" and "İ" not in w]
        lines = [" ".join(plain[i : i + 200]) for i in range(0, len(plain), 200)]
        flat = np.array([i for x in self._ids(lines) for i in x], dtype=np.uint32)
        ends = np.flatnonzero(self._ends[flat]) + 1
        if len(ends) == len(plain):
            raw, at = flat.tobytes(), (4 * np.append(0, ends)).tolist()
            self._known.update(zip(plain, (raw[a:b] for a, b in zip(at, at[1:]))))
            new = [w for w in new if w not in self._known]
        self._known.update((w, array("I", x).tobytes()) for w, x in zip(new, self._ids(new)))

    def _flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after another, and their number by word."""
        listed = words.to_pylist()
        new = [w for w in listed if w not in self._known]
        if len(self._known) + len(new) > _REMEMBERED:
            self._known.clear()
            new = listed
        self._learn(new)
        found = [self._known[w] for w in listed]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.frombuffer(b"".join(found), dtype=np.uint32), sizes

    def of(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and their number by text."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        data, edges, ends = self._words(data, np.cumsum([0, *map(len, texts)]))
        data = np.ascontiguousarray(data)
        words = pa.Array.from_buffers(
            pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]
        )
        encoded = words.dictionary_encode()
        flat, sizes = self._flat(encoded.dictionary)
        # One more entry stands for the end of a text.
        start = np.concatenate([[0], np.cumsum(sizes)])
        flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1)
        entry = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text_ends = np.searchsorted(edges[1:], ends[1:], side="right")
        entry = np.insert(entry, text_ends, len(sizes) - 1)
        entry_ends = text_ends + np.arange(1, len(texts) + 1)
        by_entry = np.concatenate([[0], np.cumsum(sizes[entry])])
        return ragged(flat, start[entry], sizes[entry]), np.diff(by_entry[np.append(0, entry_ends)])


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> WordIds:
    """One for all tasks of a worker: words that an earlier task met keep their ids."""
    return WordIds(vocabulary)


def token_table(
    docs: DataFrame, vocabulary: str, end: int = END, kept: Iterable[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Pass 1, written to the shared folder: the ``kept`` columns, ``ids`` (little-endian
    unsigned 32-bit numbers, ``end`` last), ``n_tokens``, the task and the tokens before
    the document in its task. ``vocabulary`` is the JSON of a tokenizer, whose size
    bounds what is sent to the workers.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    source = docs.select(*kept, F.col(text).alias("text"))
    width = len(source.columns) - 1
    fields = [*source.schema.fields[:width], *StructType.fromDDL(
        "ids binary, n_tokens long, task int, before long"
    ).fields]
    arrow = to_arrow_schema(StructType(fields))

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(sent.value), 0
        task = TaskContext.get().partitionId()

        def made(rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal before
            ids, sizes = encoder.of(texts, end)
            ends = before + np.cumsum(sizes)
            offsets = np.append(0, 4 * np.cumsum(sizes))
            packed = pa.Array.from_buffers(
                pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
            )
            columns = [
                *rows.columns[:width], packed, pa.array(sizes),
                pa.array(np.full(len(texts), task)), pa.array(ends - sizes),
            ]
            before = int(ends[-1])
            return pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

        for batch in it:
            texts: list[bytes] = []
            size = first = 0
            for at, value in enumerate(batch.column(width), 1):
                texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
                size += len(texts[-1])
                if size >= _BYTES or at == batch.num_rows:
                    yield made(batch.slice(first, at - first), texts)
                    texts, size, first = [], 0, at

    path = shared_folder(spark)
    table = source.mapInArrow(numbered, StructType(fields))
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _tail(total: int, window: int) -> list[int]:
    """Where the sequences of the last, incomplete window begin, and the end.

    Its length is a sum of powers of two, and a sequence of such a length is not padded.
    """
    rest = total % window
    sizes = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return list(accumulate(sizes, initial=total - rest))


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    end: int = END,
    kept: Iterable[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Every document's pieces, as they lie in sequences of ``window`` tokens.

    A document is its ids and then ``end``; a NULL or empty text is ``end`` alone. Per
    piece: the ``kept`` columns, ``start`` (tokens of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (tokens of the sequence before it). Documents follow
    one another as they are read. All sequences are full, but for the last window, which
    is cut at the powers of two that make up its length, so nothing is padded.

    Repeated rows and NULL ids are documents like any other; an empty table has no
    pieces. Kept columns with the name of a result give way to it. A task holds a
    few megabytes of texts or one text; the driver gets one number per task.
    """
    results = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kept = [c for c in kept if c not in results]
    spark = docs.sparkSession
    carried = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0))
    table = token_table(docs.select(carried.alias("row"), F.col(text).alias("text")), vocabulary, end, ["row"])
    totals = sorted(table.groupBy("task").agg(F.max(F.col("before") + F.col("n_tokens"))).collect())
    starts = list(accumulate((n for _, n in totals), initial=0))
    cuts = _tail(starts[-1], window)
    places = spark.createDataFrame(
        [(t, s) for (t, _), s in zip(totals, starts)], "task int, task_start long"
    )
    full = starts[-1] // window

    begin, stop = F.col("begin"), F.col("begin") + F.col("n_tokens")

    def piece(sequence: Column, left: Column, right: Column) -> Column:
        low, high = F.greatest(left, begin), F.least(right, stop)
        start, length = low - begin, high - low
        return F.struct(
            start.alias("start"),
            length.alias("length"),
            F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
            F.col("n_tokens").alias("doc_tokens"),
            sequence.alias("sequence_id"),
            (low - left).alias("offset"),
        )

    first, last = F.expr(f"begin div {window}"), F.expr(f"(begin + n_tokens - 1) div {window}")
    none = F.array().cast("array<bigint>")
    inner = F.when(first < full, F.sequence(first, F.least(last, F.lit(full - 1)))).otherwise(none)
    pieces = F.transform(inner, lambda w: piece(w, w * window, (w + 1) * window))
    if len(cuts) > 1:
        rest = F.array(
            *(
                F.struct(F.lit(full + i).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
            )
        )
        reached = F.filter(rest, lambda x: (x["a"] < stop) & (x["b"] > begin))
        in_rest = F.transform(reached, lambda x: piece(x["s"], x["a"], x["b"]))
        pieces = F.when(stop <= cuts[0], pieces).otherwise(F.concat(pieces, in_rest))
    placed = table.join(F.broadcast(places), "task").withColumn(
        "begin", F.col("task_start") + F.col("before")
    )
    cut = placed.select("row", F.inline(pieces))
    return cut.select(*(F.col("row")[c].alias(c) for c in kept), *results)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, n_tokens, padded_to, ids): the pieces of ``pack`` put together.

    A sequence has at most ``window`` tokens, which bounds every group.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    n = F.sum("length")
    power = F.bit_count(n) == 1
    return pieces.groupBy("sequence_id").agg(
        n.alias("n_tokens"),
        F.when(power, n).otherwise(F.lit(window)).cast("long").alias("padded_to"),
        joined.alias("ids"),
    )
