"""Small helpers of the operators: columns, shared tables, words as numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The six ASCII white-space characters, for trim() and for a Java pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; none for NULL."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-llm-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, local mode (one machine, as in tests) has a folder of its
    own; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, bucket_by: str | None = None, free: bool = False) -> DataFrame:
    """``df`` computed once into a table of the shared folder.

    It cuts the lineage, survives lost executors, and fixes the rows for all
    later reads. With ``bucket_by`` the files are dealt by that column, so that a
    join or cogroup on it needs no shuffle of this side. With ``free`` the shuffle files
    that it took are removed as soon as the table stands, not when the driver next
    collects garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    if free:
        before = spark.conf.get(_FREE, None)
        spark.conf.set(_FREE, "true")
        try:
            return written(df, bucket_by)
        finally:
            spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    if bucket_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_{uuid.uuid4().hex}"
    df.write.bucketBy(n, bucket_by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are an external table's
    return table


# --- words of one text as 64-bit numbers ------------------------------------

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Digits, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CHUNK_BYTES = 1 << 19  # texts are hashed together up to so many bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Splits texts into words of a byte class and hashes every word.

    The text is lower-cased (A-Z) first. A hash is a polynomial of random byte
    values, taken for all words of a chunk of texts at once from running sums.
    """

    def __init__(self, word_bytes: np.ndarray) -> None:
        self._is_word = word_bytes[_LOWER]
        self._value = _BYTE_VALUE[_LOWER]
        self._up = self._down = np.empty(0, dtype=np.uint64)

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and the offsets where they start."""
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = self._is_word[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        if len(data) > len(self._up):
            self._up = _powers(max(len(data), CHUNK_BYTES), _BASE)
            self._down = _powers(max(len(data), CHUNK_BYTES), _INVERSE)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._value[data] * self._up[: len(data)], out=sums[1:])
        size = (end - start).astype(np.uint64)
        return mix((sums[end] - sums[start]) * self._down[start] + size), start

    def hashes(self, text: str | None) -> np.ndarray:
        """One number per word, in text order; none for NULL."""
        data = (text or "").encode("utf-8", "surrogatepass")
        return self._hashes(np.frombuffer(data, dtype=np.uint8))[0]

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of every text of an Arrow column, in order.

        Neighbouring texts are hashed together, each followed by a byte that is
        in no word, so that short texts cost no calls of their own.
        """
        chunk: list[bytes] = []
        size = 0
        for value in texts:
            raw = value.as_buffer() if value.is_valid else None
            chunk.append(raw.to_pybytes() if raw is not None else b"")
            size += len(chunk[-1])
            if size >= CHUNK_BYTES:
                yield from self._together(chunk)
                chunk, size = [], 0
        yield from self._together(chunk)

    def _together(self, chunk: list[bytes]) -> Iterator[np.ndarray]:
        if chunk:
            h, start = self._hashes(np.frombuffer(b" ".join(chunk), dtype=np.uint8))
            ends = np.cumsum([len(x) + 1 for x in chunk])
            yield from np.split(h, np.searchsorted(start, ends[:-1]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One number per window of ``n`` consecutive words."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:count].copy()
    for i in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + count]
    return mix(out)


def appended(
    df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """``df`` with the columns ``compute`` derives from each Arrow batch.

    ``fields`` is a schema string. Columns of ``df`` with those names are
    replaced; rows stay in place, so no shuffle is needed.
    """
    new = StructType.fromDDL(fields)
    df = df.drop(*new.names)
    names = [*df.columns, *new.names]
    types = [f.type for f in to_arrow_schema(new)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = [a.cast(t) for a, t in zip(compute(batch), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(batches, StructType([*df.schema.fields, *new.fields]))
