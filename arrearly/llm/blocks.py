"""Texts as numbered tokens, in blocks with a dictionary of their own.

Work on distinct tokens (encode each once, count each) needs a shuffle by token,
and its results have to come back to every place where the token stands. Moving
one row per place would move the corpus several times over. Instead the texts
of a task are numbered against a dictionary of their distinct tokens; only
dictionaries are dealt out by token, and only their answers come back, to be put
into place by number.

A block row has
    block    a random number
    rows     the kept columns, whether the text is marked for counting, and its
             number of tokens, for every text in order
    n_counted  tokens of the marked texts
    codes    all tokens of the block: numbers in the dictionary, most frequent first
    buckets  the hash bucket of every dictionary entry, by number
    words    per bucket: the tokens in it in the order of their numbers, and how
             often each occurs in the texts marked for counting
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from arrearly.llm.common import written

#: Tokens after which a block is closed; texts are not divided.
BLOCK_TOKENS = 1_000_000
#: Texts that are cut into tokens at a time.
_TEXTS = 64
#: Texts that are sent to a worker at a time.
_BATCH = 1000
_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack_numbers(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers, byte by byte of equal weight, which compresses best."""
    return pack(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_numbers(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(unpack(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _both(data: bytes) -> tuple[bytes, bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    return data[8:cut], data[cut:]


def pack_codes(x: np.ndarray) -> bytes:
    """Numbers of which most are small: a byte each, and the rest of the others."""
    return _pair(pack(np.minimum(x, 255).astype(np.uint8).tobytes()), pack_numbers(x[x >= 255] - 255))


def unpack_codes(data: bytes) -> np.ndarray:
    small, rest = _both(data)
    x = np.frombuffer(unpack(small), dtype=np.uint8).astype(np.int64)
    x[x == 255] += unpack_numbers(rest)
    return x


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), dtype=np.uint32, count=len(words))
    return _pair(pack_numbers(sizes), pack(b"".join(words)))


def unpack_words(data: bytes) -> list[bytes]:
    sizes, text = _both(data)
    ends = np.cumsum(unpack_numbers(sizes), dtype=np.int64).tolist()
    text = unpack(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    shift = start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start
    return values[np.repeat(shift, size) + np.arange(size.sum())]


def _block(rows: pa.Table, sizes: np.ndarray, tokens: pa.ChunkedArray, n_buckets: int) -> dict:
    encoded = tokens.combine_chunks().dictionary_encode()
    raw = encoded.indices.to_numpy(zero_copy_only=False)
    by_count = np.argsort(-np.bincount(raw, minlength=len(encoded.dictionary)), kind="stable")
    number = np.empty(len(by_count), dtype=np.int32)
    number[by_count] = np.arange(len(by_count), dtype=np.int32)
    codes = number[raw]
    words = encoded.dictionary.take(pa.array(by_count)).to_pylist()
    counted = np.repeat(np.array(rows.column("counted").to_pylist(), dtype=bool), sizes)
    counts = np.bincount(codes[counted], minlength=len(words))
    buckets = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    buckets %= np.uint32(n_buckets)
    order = np.argsort(buckets, kind="stable")
    present, first = np.unique(buckets[order], return_index=True)
    rows = rows.append_column("n_tokens", pa.array(sizes, pa.int64()))
    return {
        "block": random.SystemRandom().getrandbits(63),
        "rows": rows.to_pylist(),
        "n_counted": int(counted.sum()),
        "codes": pack_codes(codes),
        "buckets": pack_numbers(buckets),
        "words": [
            {
                "bucket": int(b),
                "words": pack_words([words[i] for i in part]),
                "counts": pack_numbers(counts[part], 8),
            }
            for b, part in zip(present, np.split(order, first[1:]))
        ],
    }


def nullable(kind: DataType) -> DataType:
    """The type with NULL allowed at every level, as Arrow columns come back."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def blocks(
    docs: DataFrame,
    kept: list[str],
    tokenize: Callable[[pa.Array], tuple[pa.Array, np.ndarray]],
    column: str,
    counted: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The block table of ``docs``, written to the shared folder and dealt by block, so
    that answers are moved to the blocks and not the blocks to them.

    ``tokenize`` turns an Arrow column into all its tokens (binary) and their
    number per row. ``counted`` names a boolean column. The number of buckets
    follows ``spark.sql.shuffle.partitions``, which is set to suit the data.
    """
    n_buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        *(F.col(c).cast(nullable(docs.schema[c].dataType)).alias(c) for c in kept),
        F.coalesce(F.col(counted) if counted else F.lit(True), F.lit(False)).alias("counted"),
        F.col(column),
    )
    # Types are put together as such: a nested column may have any name.
    row = StructType([*source.schema.fields[: len(kept)], *StructType.fromDDL("counted boolean, n_tokens bigint").fields])
    rest = StructType.fromDDL(
        "n_counted bigint, codes binary, buckets binary, "
        "words array<struct<bucket: int, words: binary, counts: binary>>"
    )
    schema = StructType.fromDDL("block bigint").add("rows", ArrayType(row))
    schema = StructType([*schema.fields, *rest.fields])
    arrow = to_arrow_schema(schema)

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, tokens, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            made = _block(
                pa.Table.from_batches(rows), np.concatenate(sizes),
                pa.chunked_array(tokens, pa.binary()), n_buckets,
            )
            return pa.RecordBatch.from_pylist([made], schema=arrow)

        for batch in it:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                found, size = tokenize(part.column(len(kept) + 1))
                rows.append(part.select(list(range(len(kept) + 1))))
                sizes.append(size)
                tokens.append(found)
                total += len(found)
                if total >= block_tokens:
                    yield closed()
                    rows, sizes, tokens, total = [], [], [], 0
                    pa.default_memory_pool().release_unused()
        if rows:
            yield closed()

    # Texts come as arrays of tokens, so few of them make a large batch.
    spark, size = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(min(_BATCH, int(before)) if int(before) > 0 else _BATCH))
    try:
        return written(source.mapInArrow(pieces, schema), bucket_by="block")
    finally:
        spark.conf.set(size, before)


def dealt_words(table: DataFrame) -> DataFrame:
    """(block, bucket, words, counts): one row per block and bucket."""
    return table.select("block", F.inline("words"))


def places(buckets: np.ndarray) -> np.ndarray:
    """For every dictionary number, its place among the words of all buckets in order."""
    order = np.argsort(buckets, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place
