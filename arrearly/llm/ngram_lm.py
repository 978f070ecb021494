"""Language-model scores from a weighted backoff automaton.

Every n-gram of the training texts up to ``ORDER`` words is counted and has an
arc. A state is a context, an arc (state, word) reads a word and adds its smoothed
log-probability, a failure arc leads to the next shorter context and adds the
backoff weight. The automaton grows with the corpus, so no task holds it: words
and n-grams are dealt by hash into buckets, which count them and number them (the
number of an n-gram is its state), and every block of texts gets back the arcs
and weights of its own n-grams, as it gets the counts of its words (see
``blocks``). Sums over the arcs of a state are taken per bucket first, so a
context with many followers is spread.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearly.llm.blocks import (
    blocks,
    dealt_words,
    pack_numbers,
    places,
    unpack_codes,
    unpack_numbers,
    unpack_words,
)
from arrearly.llm.common import mix, written

RATE = 0.0  # least share of the training tokens of an n-gram with an arc: none
ORDER = 3  # longest n-gram
DISCOUNT = 0.5  # taken off every n-gram's count and left to shorter contexts
END = b" "  # ends every text; no word holds a space
BUCKET_NGRAMS = 1_500_000  # n-grams of a length that are counted together, at least

# What is sent to blocks (and, as SUMS, to the buckets of states): packed numbers.
_SENT = "kind int, block bigint, bucket int, a binary, b binary, c binary, d binary"
_NAMES = ["kind", "block", "bucket", "a", "b", "c", "d"]
WORD, PAIR, TRIPLE, WORD_SUMS, PAIR_SUMS, SUMS, ASKED = range(7)


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space, and the end, of every text."""
    found, sizes = [], []
    for value in column:
        words = value.as_buffer().to_pybytes().lower().split() if value.is_valid else []
        found += words
        found.append(END)
        sizes.append(len(words) + 1)
    return pa.array(found, pa.binary()), np.array(sizes, dtype=np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0, each in as many bytes as the largest needs."""
    width = np.min_scalar_type(int(x.max(initial=0))).itemsize
    return bytes([width]) + pack_numbers(x, width)


def _unpack(x: bytes) -> np.ndarray:
    return unpack_numbers(x[1:], x[0]).astype(np.int64)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x))


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=_NAMES)


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair of numbers, different for different pairs."""
    if len(a) and max(a.max(), b.max()) >= 2**31:
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
    return a << 32 | b


def _ranks(number: np.ndarray) -> np.ndarray:
    """The places of different numbers among them."""
    out = np.empty(len(number), dtype=np.int64)
    out[np.argsort(number)] = np.arange(len(number))
    return out


def _by_bucket(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """The stable order by bucket. Numbers of one or two bytes are sorted by radix."""
    return np.argsort(bucket.astype(np.min_scalar_type(n_buckets)), kind="stable")


def _sums(inverse: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    return np.bincount(inverse, weights=x, minlength=n).astype(np.int64)


class _Setup(NamedTuple):
    least: float  # count of an n-gram with an arc
    word_buckets: int
    n_buckets: int  # of n-grams and states


class _Block:
    """A block's distinct pairs and triples, and what is known of them.

    A pair is a word and a word, a triple is a pair and a word; ``last`` is the
    number in the dictionary, ``first`` that in the dictionary or among the pairs.
    """

    def __init__(self, row: dict, sent: pa.Table, order: int, setup: _Setup) -> None:
        self.sent, self.least, self.n_buckets = sent.sort_by("bucket"), setup.least, setup.n_buckets
        self.rows = row["rows"]
        self.sizes = np.array([r["n_tokens"] for r in self.rows], dtype=np.int64)
        self.codes = unpack_codes(row["codes"])
        self.place = places(unpack_numbers(row["buckets"]))
        self.word_number = self.numbers(WORD, setup.word_buckets, _unpack)[self.place]
        self.word_count = self.listed(WORD, "b")[self.place]
        size = len(self.place)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        counted = np.repeat(np.array([r["counted"] for r in self.rows], dtype=bool), self.sizes)

        self.pair_place = np.flatnonzero(text[:-1] == text[1:])
        key = self.codes[self.pair_place] * size + self.codes[self.pair_place + 1]
        pairs, self.pair_at = np.unique(key, return_inverse=True)
        self.pair_first, self.pair_last = np.divmod(pairs, max(1, size))
        self.pair_counted = _sums(self.pair_at, len(pairs), counted[self.pair_place])
        self.pair_state = self.word_number[self.pair_first]
        self.pair_suffix = self.word_count[self.pair_last]
        if order == 2:
            return
        self.pair_order = self.dealt(2)[0]
        self.pair_number = np.empty(len(pairs), dtype=np.int64)
        self.pair_number[self.pair_order] = self.numbers(PAIR, self.n_buckets, _unpack_sorted)
        self.pair_count = self.back(self.pair_order, PAIR, "b")
        at = np.zeros(len(text), dtype=np.int64)
        at[self.pair_place] = self.pair_at
        self.triple_place = np.flatnonzero(text[:-2] == text[2:])
        key = at[self.triple_place] * size + self.codes[self.triple_place + 2]
        triples, self.triple_at = np.unique(key, return_inverse=True)
        self.triple_first, self.triple_last = np.divmod(triples, max(1, size))
        self.triple_counted = _sums(self.triple_at, len(triples), counted[self.triple_place])
        self.triple_state = self.pair_number[self.triple_first]
        self.triple_rest = np.zeros(len(triples), dtype=np.int64)  # its last two words, a pair
        self.triple_rest[self.triple_at] = at[self.triple_place + 1]
        self.triple_suffix = self.pair_count[self.triple_rest]

    def listed(self, kind: int, column: str) -> np.ndarray:
        part = self.sent.column(column).filter(pc.equal(self.sent.column("kind"), kind))
        found = [_unpack(x) for x in part.to_pylist()]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def numbers(
        self, kind: int, n_buckets: int, unpacked: Callable[[bytes], np.ndarray]
    ) -> np.ndarray:
        """Numbers in a bucket are sent without it, which is the row's."""
        part = self.sent.filter(pc.equal(self.sent.column("kind"), kind))
        rows = zip(part.column("a").to_pylist(), part.column("bucket").to_pylist())
        found = [unpacked(x) * n_buckets + b for x, b in rows]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def back(self, order: np.ndarray, kind: int, column: str) -> np.ndarray:
        out = np.empty(len(order), dtype=np.int64)
        out[order] = self.listed(kind, column)
        return out

    def dealt(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which n-grams of a length are sent, by bucket, state and word, and
        their buckets. Their buckets number them in the same order."""
        number, first, last = (
            (self.word_number, self.pair_first, self.pair_last) if n == 2
            else (self.pair_number, self.triple_first, self.triple_last)
        )
        word = self.word_number[last].astype(np.uint64)
        bucket = mix(mix(number[first].astype(np.uint64)) + word) % np.uint64(self.n_buckets)
        # An n-gram has a key of its own, so there is one order whatever the sort.
        size = len(self.word_number)
        if len(number) and int(number.max()) >= 2**62 // size:
            number = _ranks(number)
        order = np.argsort(number[first] * size + _ranks(self.word_number)[last])
        order = order[_by_bucket(bucket[order], self.n_buckets)]
        return order, bucket[order].astype(np.int64)

    def without_arc(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first parts of the n-grams of a length that may have no arc, by bucket and
        state, and their buckets. Only there a failure arc is taken: what the marked texts
        of this block hold often enough has an arc."""
        number, first, counted = (
            (self.word_number, self.pair_first, self.pair_counted) if n == 2
            else (self.pair_number, self.triple_first, self.triple_counted)
        )
        part = np.unique(first[counted < self.least])
        part = part[np.argsort(number[part])]
        bucket = number[part] % self.n_buckets
        order = _by_bucket(bucket, self.n_buckets)
        return part[order], bucket[order]

    def asked(self, block: int, n: int) -> pa.Table:
        """The n-grams of a length by bucket: state, word, count in the marked texts, and
        the count of the n-gram without its first word. Then the states ``without_arc``."""
        name = "pair" if n == 2 else "triple"
        state, last, counted, suffix = (
            getattr(self, f"{name}_{x}") for x in ("state", "last", "counted", "suffix")
        )
        order, bucket = self.dealt(n)
        present, start = np.unique(bucket, return_index=True)
        parts = np.split(order, start[1:]) if len(start) else []
        kind = PAIR if n == 2 else TRIPLE
        out = [
            (kind, block, int(b), _pack_sorted(state[i]), _pack(self.word_number[last[i]]),
             _pack(counted[i]), _pack(suffix[i]))
            for b, i in zip(present, parts)
        ]
        part, bucket = self.without_arc(n)
        number = (self.word_number if n == 2 else self.pair_number)[part]
        present, start = np.unique(bucket, return_index=True)
        for b, x in zip(present, np.split(number, start[1:])):
            out.append((ASKED, block, int(b), _pack_sorted(x), None, None, None))
        return _table(out)

    def sums(self, n: int, size: int) -> np.ndarray:
        """What ``_state_sums`` says of the states ``without_arc``, 0 for all others."""
        out = np.zeros((3, size), dtype=np.int64)
        part = self.without_arc(n)[0]
        for x, column in zip(out, "abc"):
            x[part] = self.listed(WORD_SUMS if n == 2 else PAIR_SUMS, column)
        return out

    def scores(self, total: int, distinct: int) -> np.ndarray:
        """The log-probability of every token after the two before it."""
        least = self.least
        everything = total + distinct + 1
        arc = lambda n, context: np.log10(
            np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(context, 1)
        )
        one = np.log10((self.word_count + 1) / everything)
        d, n, s = self.sums(2, len(self.place))
        count = np.maximum(self.word_count, 1)
        fail = np.log10((count - n + DISCOUNT * d) / count * everything / (everything - s - d))
        fail = np.where(self.word_count >= least, fail, 0.0)
        first = self.pair_first
        two = np.where(
            self.pair_count >= least,
            arc(self.pair_count, self.word_count[first]),
            fail[first] + one[self.pair_last],
        )
        d, n, s = self.sums(3, len(self.pair_first))
        pair, word = np.maximum(self.pair_count, 1), np.maximum(self.word_count[self.pair_last], 1)
        fail = np.log10((pair - n + DISCOUNT * d) / pair * word / (word - s + DISCOUNT * d))
        fail = np.where(self.pair_count >= least, fail, 0.0)
        order = self.dealt(3)[0]
        triple = self.back(order, TRIPLE, "b")
        three = np.where(
            triple >= least,
            arc(triple, self.pair_count[self.triple_first]),
            fail[self.triple_first] + two[self.triple_rest],
        )
        out = one[self.codes]
        out[self.pair_place + 1] = two[self.pair_at]
        out[self.triple_place + 2] = three[self.triple_at]
        return out


def _count_words(table: DataFrame) -> DataFrame:
    """Number and count of all words by block; the first row of a bucket has, as c, how
    many words of the bucket stand in the marked texts."""

    def count_bucket(rows: pa.Table) -> pa.Table:
        sent = [unpack_words(x) for x in rows.column("words").to_pylist()]
        counts: dict[bytes, int] = {}
        for words, packed in zip(sent, rows.column("counts").to_pylist()):
            for word, n in zip(words, unpack_numbers(packed, 8).tolist()):
                counts[word] = counts.get(word, 0) + n
        number = {w: i for i, w in enumerate(counts)}
        bucket = rows.column("bucket")[0].as_py()
        known = _pack(np.array([sum(c > 0 for c in counts.values())]))
        return _table([
            (WORD, block, bucket, _pack(np.array([number[w] for w in x])),
             _pack(np.array([counts[w] for w in x])), None if i else known, None)
            for i, (block, x) in enumerate(zip(rows.column("block").to_pylist(), sent))
        ])

    counted = dealt_words(table).groupBy("bucket").applyInArrow(count_bucket, _SENT)
    return written(counted, free=True)


def _count_ngrams(
    table: DataFrame, sent: DataFrame, n: int, setup: _Setup
) -> DataFrame:
    """State and count of all n-grams of a length by block, and, by bucket of the state
    that they leave: how many arcs it has, the sum of their counts, and of the counts
    of the n-grams without the first word. The states whose sums blocks ask for are
    handed on."""
    least, n_buckets = setup.least, setup.n_buckets

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [
            _Block(row, right, n, setup).asked(row["block"], n)
            for row in left.to_pylist()
        ]
        return pa.concat_tables(made) if made else _table([])

    def count_bucket(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        asked = pc.equal(rows.column("kind"), ASKED)
        out = [(ASKED, r["block"], bucket, r["a"], *[None] * 3) for r in rows.filter(asked).to_pylist()]
        rows = rows.filter(pc.invert(asked))
        if not rows.num_rows:
            return _table(out)
        states = [_unpack_sorted(x) for x in rows.column("a").to_pylist()]
        state = np.concatenate(states)
        word, counted, suffix = (
            np.concatenate([_unpack(x) for x in rows.column(c).to_pylist()]) for c in "bcd"
        )
        ngrams, at = np.unique(_joint(state, word), return_inverse=True)
        count = _sums(at, len(ngrams), counted)
        ends = np.cumsum([len(x) for x in states])[:-1]
        out += [
            (PAIR if n == 2 else TRIPLE, block, bucket,
             _pack_sorted(i) if n < ORDER else None, _pack(count[i]), None, None)
            for block, i in zip(rows.column("block").to_pylist(), np.split(at, ends))
        ]
        kept = np.flatnonzero(count >= least)
        left, rest = np.empty_like(count), np.empty_like(count)
        left[at], rest[at] = state, suffix
        left = left[kept]  # in order, as the n-grams are
        first = np.flatnonzero(np.diff(left, prepend=-1))
        sums = [np.add.reduceat(x, first) for x in (np.ones_like(left), count[kept], rest[kept])]
        left = left[first]
        to = left % n_buckets
        order = _by_bucket(to, n_buckets)
        present, start = np.unique(to[order], return_index=True)
        for b, i in zip(present, np.split(order, start[1:])):
            out.append((SUMS, None, int(b), _pack_sorted(left[i]), *[_pack(x[i]) for x in sums]))
        return _table(out)

    asked = _by_block(table, sent, ask, _SENT)
    return written(asked.groupBy("bucket").applyInArrow(count_bucket, _SENT), free=True)


def _state_sums(ngrams: DataFrame, kind: int, n_buckets: int) -> DataFrame:
    """The sums over the arcs of the states that a block asked for, in its order.

    The states of a bucket are numbered without gaps, so a number is a place."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        def joined(column: str, unpacked: Callable[[bytes], np.ndarray]) -> np.ndarray:
            found = [unpacked(x) for x in right.column(column).to_pylist()]
            return np.concatenate([np.empty(0, dtype=np.int64), *found])

        at = joined("a", _unpack_sorted) // n_buckets
        size = at.max(initial=0) + 1
        # The last place is that of all states without arcs.
        sums = [_sums(at, size + 1, joined(c, _unpack)) for c in "bcd"]
        out = []
        for block, bucket, numbers in zip(*(left.column(c).to_pylist() for c in ("block", "bucket", "a"))):
            place = np.minimum(_unpack_sorted(numbers) // n_buckets, size)
            out.append((kind, block, bucket, *[_pack(x[place]) for x in sums], None))
        return _table(out)

    asked = ngrams.where(F.col("kind") == ASKED).select("block", "bucket", "a")
    arcs = ngrams.where(F.col("kind") == SUMS).select("bucket", "a", "b", "c", "d")
    return (
        asked.groupBy("bucket").cogroup(arcs.groupBy("bucket")).applyInArrow(add, _SENT)
    )


def _by_block(
    table: DataFrame, sent: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    return (
        table.select("block", "rows", "codes", "buckets")
        .groupBy("block")
        .cogroup(sent.groupBy("block"))
        .applyInArrow(f, schema)
    )


def score_texts(
    docs: DataFrame, counted: str, doc_id: str = "doc_id", text: str = "text", rate: float = RATE
) -> DataFrame:
    """Scores of all texts by a model of those whose boolean column ``counted`` is true.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (unigrams with one
    added to every count) and score (the automaton). A NULL or empty text is one
    end; NULL in ``counted`` is false. Without training texts every token is
    unknown with probability one. One row per row, whatever repeats. A ``rate``
    above zero leaves arcs to n-grams of that share of the training tokens.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), counted)
    table = blocks(source, ["doc_id"], _words, "text", counted)
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["n_tokens"])
    total, tokens = (x or 0 for x in table.agg(F.sum("n_counted"), F.sum(sizes)).first())
    # No more buckets than the texts fill, for every block sends to every bucket.
    n_buckets = min(2 * partitions, 1 + tokens // BUCKET_NGRAMS)
    setup = _Setup(max(1.0, rate * total), 8 * partitions, n_buckets)  # words: see ``blocks``
    words = _count_words(table)
    known = words.where("c IS NOT NULL").select("c").collect()  # one short row a bucket
    distinct = sum(int(_unpack(bytes(r["c"]))[0]) for r in known)
    pairs = _count_ngrams(table, words, 2, setup)
    states = pairs.where(F.col("kind") == PAIR)
    triples = _count_ngrams(table, words.union(states), 3, setup)
    # Written on their own, so that what they are made of is gone when all is sent.
    sums = written(
        _state_sums(pairs, WORD_SUMS, n_buckets).union(
            _state_sums(triples, PAIR_SUMS, n_buckets)
        ),
        free=True,
    )
    sent = words.union(states).union(triples.where(F.col("kind") == TRIPLE)).union(sums)
    kind = source.schema["doc_id"].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = _Block(row, right, ORDER, setup)
            start = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
            count = block.word_count[block.codes]
            alone = np.log10((count + 1) / (total + distinct + 1))
            added = [
                np.add.reduceat(x, start)
                for x in ((count > 0).astype(np.int64), alone, block.scores(total, distinct))
            ]
            for r, n_known, base, whole in zip(block.rows, *(x.tolist() for x in added)):
                out.append(
                    {
                        "doc_id": r["doc_id"],
                        "n_tokens": r["n_tokens"],
                        "n_known": n_known,
                        "train_tokens": total,
                        "base_score": base,
                        "score": whole,
                    }
                )
        return pa.Table.from_pylist(
            out,
            pa.schema(
                {
                    "doc_id": left.schema.field("rows").type.value_type.field("doc_id").type,
                    "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
                    "base_score": pa.float64(), "score": pa.float64(),
                }
            ),
        )

    return _by_block(
        table,
        sent,
        score,
        f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )
