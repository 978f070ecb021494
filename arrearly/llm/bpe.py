"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Texts are cut into pre-tokens (natively), numbered against block dictionaries
(see ``blocks``), and the dictionaries are dealt out by pre-token. Where equal
pre-tokens meet, the merges run once for each; the ids travel back to the blocks
and are put together by position.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from arrearly.llm.blocks import (
    BLOCK_TOKENS,
    blocks,
    dealt_words,
    nullable,
    pack_numbers,
    places,
    ragged,
    unpack_codes,
    unpack_numbers,
    unpack_words,
)
from arrearly.llm.common import appended

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """A rank file: base64 of a token's bytes and its id on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _merged_short(piece: bytes, ranks: Ranks) -> list[int]:
    """Looks for the lowest of all pairs for every merge: quickest for a few bytes."""
    none = 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merged(piece: bytes, ranks: Ranks) -> list[int]:
    """The ids of one pre-token: again and again the pair of lowest rank is merged,
    the leftmost of equals. A heap keeps long pieces near-linear."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= 24:
        return _merged_short(piece, ranks)
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once swallowed
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop, end[stop]))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _java(pattern: str) -> str:
    """The splitting pattern with Unicode white space, as its own library reads it."""
    return "(?U)" + pattern


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().cast(pa.binary()), sizes


def _token_bytes(ranks: Ranks) -> list[bytes]:
    """The bytes of every id, by id."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(
    docs: DataFrame,
    ranks: Ranks,
    pattern: str,
    kept: Iterable[str] = ("doc_id",),
    text: str = "text",
    decoded: bool = False,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The ``kept`` columns of every row with ``n_tokens`` and ``ids`` (array<int>), and if
    asked for ``decoded``, the bytes of the ids, as ``decode`` gives them.

    Special tokens are not recognised. A NULL text is an empty one, without
    ids. One row comes back per row, repeated rows and NULL ids included; an
    empty table gives an empty one. ``ranks`` must hold all 256 single bytes;
    its size bounds what is sent to the workers. Smaller ``block_tokens`` take less memory
    of a worker and more dictionaries.
    """
    kept = list(kept)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack some single byte, so some texts have no ids")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    # In the worker that puts the ids together: a second one per core would cost memory.
    sent_bytes = docs.sparkSession.sparkContext.broadcast(_token_bytes(ranks) if decoded else [])
    tokens = F.regexp_extract_all(
        F.coalesce(F.col(text), F.lit("")), F.lit(_java(pattern)), F.lit(0)
    )
    source = docs.select(*kept, tokens.alias("pre_tokens"))
    table = blocks(source, kept, _flat, "pre_tokens", block_tokens=block_tokens)

    def encode_bucket(rows: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        ranks, sizes, ids = sent.value, [], []
        for packed in rows.column("words"):
            found = []
            for word in unpack_words(packed.as_py()):
                if word not in known:
                    known[word] = merged(word, ranks)
                found.append(known[word])
            sizes.append(pack_numbers(np.fromiter(map(len, found), np.uint32, len(found))))
            ids.append(pack_numbers(np.fromiter((i for x in found for i in x), np.uint32)))
        return pa.table(
            {
                "block": rows.column("block"), "bucket": rows.column("bucket"),
                "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary()),
            }
        )

    answers = (
        dealt_words(table)
        .select("block", "bucket", "words")
        .groupBy("bucket")
        .applyInArrow(encode_bucket, "block bigint, bucket int, sizes binary, ids binary")
    )
    results = "n_tokens bigint, ids array<int>" + ", decoded binary" * decoded
    fields = [StructField(c, nullable(docs.schema[c].dataType)) for c in kept]
    schema = StructType([*fields, *StructType.fromDDL(results).fields])

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        size, flat = (
            np.concatenate([unpack_numbers(x) for x in right.column(c).to_pylist()] or [[]])
            for c in ("sizes", "ids")
        )
        size, flat = size.astype(np.int64), flat.astype(np.int32)
        out = []
        for block in range(left.num_rows):
            place = places(unpack_numbers(left.column("buckets")[block].as_py()))
            start = np.concatenate([[0], np.cumsum(size)])
            codes = place[unpack_codes(left.column("codes")[block].as_py())]
            rows = left.column("rows")[block].values
            n = np.array(rows.field("n_tokens").to_pylist(), dtype=np.int64)
            ids = [
                ragged(flat, start[c], size[c])
                for c in np.split(codes, np.cumsum(n)[:-1])
            ]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            made = {c: rows.field(c) for c in kept} | {
                "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                "ids": pa.ListArray.from_arrays(ends, np.concatenate(ids)),
            }
            if decoded:
                token = sent_bytes.value.__getitem__
                texts = [b"".join(map(token, x.tolist())) for x in ids]
                made["decoded"] = pa.array(texts, pa.binary())
            out.append(pa.table(made))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return (
        table.select("block", "rows", "codes", "buckets")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(reassemble, schema)
    )


def decode(encoded: DataFrame, ranks: Ranks, ids_digest: bool = False) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids``.

    The table from ids to bytes is as large as the vocabulary, so it is sent to
    the rows and joined there by position. NULL ids give NULL; a column named
    ``decoded`` is replaced. ``ids_digest`` adds ``ids_sha256`` in the same pass,
    of the ids as little-endian 32-bit numbers.
    """
    table = _token_bytes(ranks)
    sent = encoded.sparkSession.sparkContext.broadcast(table)
    fields = "decoded binary" + ", ids_sha256 string" * ids_digest
    column = encoded.drop("decoded", *["ids_sha256"] * ids_digest).columns.index("ids")

    def join(batch: pa.RecordBatch) -> list[pa.Array]:
        token = sent.value.__getitem__
        texts, digests = [], []
        for x in batch.column(column):
            ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
            texts.append(None if ids is None else b"".join(map(token, ids.tolist())))
            if ids_digest:
                raw = None if ids is None else ids.astype("<u4").tobytes()
                digests.append(None if raw is None else hashlib.sha256(raw).hexdigest())
        return [pa.array(texts, pa.binary())] + [pa.array(digests, pa.string())] * ids_digest

    return appended(encoded, fields, join)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[Ranks, str]:
    """Ranks and splitting pattern of a public vocabulary file."""
    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
