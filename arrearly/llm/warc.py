"""WARC archives as a Spark data source, and payload deduplication by revisits.

``spark.read.format("warc")`` plans one partition per archive file. Predicates
on record columns are pushed into the reader, which parses a record's headers
first and steps over the payload of a record that is not wanted, or of any
record when the read schema has no ``payload``. Records are written as gzip
members of their own; the member's extra field says how long it is, so that a
payload can be passed over without being inflated. Archives of other origin,
compressed or not, are read too.

Files are reached through Arrow's file systems (local, HDFS, S3, GCS) by URI, so
a cluster's shared folder serves driver and executors alike.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

# Columns that stand in the headers, with the header's name.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
# Alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LONGEST_HEADER = 1 << 20


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: every five hex digits are four characters."""
    hexed = F.sha1(data)

    def four(i: Column) -> Column:
        bits = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[
                F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1))
                for s in (15, 10, 5, 0)
            ]
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


# --- records ------------------------------------------------------------------


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field holds its own length and the record's."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"SL" + (8).to_bytes(2, "little") + b"".join(
        (n & 0xFFFFFFFF).to_bytes(4, "little") for n in (size, len(record))
    )
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + len(extra).to_bytes(2, "little") + extra
    tail = zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    return head + body + tail


def _record(columns: dict[str, str | None], payload: bytes, date: str) -> bytes:
    """One record; line breaks in a header value become spaces."""
    lines = ["WARC/1.0", f"WARC-Date: {date}"]
    for column, header in HEADERS.items():
        value = columns.get(column)
        if value is not None:
            lines.append(f"{header}: " + re.sub(r"[\r\n]+", " ", value))
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parsed(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


class _Inflated(io.RawIOBase):
    """The bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, source: io.BufferedReader) -> None:
        self._source, self._inflate = source, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self._inflate.eof:
            data = self._inflate.unconsumed_tail or self._source.read(1 << 14)
            if not data:
                return 0
            out = self._inflate.decompress(data, len(into))
            if self._inflate.eof:  # what was read too far belongs to the next member
                self._source.seek(-len(self._inflate.unused_data), io.SEEK_CUR)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0

    def finish(self) -> None:
        while self.read(1 << 16):
            pass


def _head(source: io.BufferedReader) -> bytes:
    lines = []
    while True:
        line = source.readline(_LONGEST_HEADER)
        if line in (b"\r\n", b"\n") and not lines:
            continue  # blank lines between records
        if line in (b"\r\n", b"\n", b""):
            return b"".join(lines)
        lines.append(line)


def records(source: io.BufferedReader, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, payload) of the records whose headers are ``wanted``."""
    while True:
        start = source.tell()
        magic = source.read(4)
        if not magic.strip():
            if not magic:
                return
            continue
        source.seek(start)
        if magic[:2] == b"\x1f\x8b":
            fixed = source.read(24)
            length = int.from_bytes(fixed[16:20], "little") if fixed[3] & 4 and fixed[12:14] == b"SL" else 0
            source.seek(start)
            member = _Inflated(source)
            text = io.BufferedReader(member, 1 << 12)
            headers = _parsed(_head(text))
            if headers and wanted(headers):
                size = int(headers.get("content-length", 0))
                yield headers, text.read(size) if with_payload else None
            if length:
                source.seek(start + length)
            else:
                member.finish()
        else:
            headers = _parsed(_head(source))
            if not headers:
                return
            size = int(headers.get("content-length", 0))
            if wanted(headers) and with_payload:
                yield headers, source.read(size)
            else:
                if wanted(headers):
                    yield headers, None
                source.seek(size, io.SEEK_CUR)


# --- data source ---------------------------------------------------------------


@dataclass
class WarcFile(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.uri = schema, options["path"]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", StringStartsWith: "starts"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and type(f) in kinds:
                self.tests.append((HEADERS[column].lower(), kinds[type(f)], f.value))
            elif column in HEADERS and isinstance(f, (IsNotNull, IsNull)):
                self.tests.append((HEADERS[column].lower(), type(f).__name__, None))
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        for header, kind, value in self.tests:
            found = headers.get(header)
            if kind == "IsNull" or (kind == "<=>" and value is None):
                ok = found is None
            elif found is None:
                ok = False
            elif kind == "in":
                ok = found in value
            elif kind == "starts":
                ok = found.startswith(value)
            else:
                ok = kind == "IsNotNull" or found == value
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        if not found and system.get_file_info(path).type == fs.FileType.File:
            return [WarcFile(path)]
        names = [f.path for f in found if f.type == fs.FileType.File]
        return [WarcFile(n) for n in sorted(names) if re.search(r"\.warc(\.gz)?$", n)]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        names = self.schema.names
        arrow = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in names])
        rows, size = [], 0
        # Without files Spark plans one empty partition.
        if partition is None:
            return
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 20) as source:
            for headers, payload in records(source, self._wanted, "payload" in names):
                row = {c: headers.get(HEADERS[c].lower()) for c in names if c != "payload"}
                rows.append(row | ({"payload": payload} if "payload" in names else {}))
                size += len(payload or b"") + 200
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class WarcWriter(DataSourceArrowWriter):
    """Every task writes files under a temporary name; the commit renames them."""

    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.roll = int(options.get("fileBytes", 1 << 27))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.uri)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    files.append((name + ".unfinished", name))
                    out = system.open_output_stream(name + ".unfinished", compression=None)
                out.write(_member(_record(row, row.get("payload") or b"", self.date)))
                if out.tell() > self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.uri)
        for made, name in (x for m in messages if m for x in m.files):
            system.move(made, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.uri)
        for made, _ in (x for m in messages if m for x in m.files):
            system.delete_file(made)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the ``warc`` format known to the session and allows pushdown into it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages ----------------------------------------------------------------------


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records of ``pages`` (page_id, url, html), equal payloads stored once.

    Of equal payloads of at least ``min_bytes`` the one with the smallest page_id
    is a response and the others revisit it; shorter ones are all responses. A
    NULL html is an empty payload, a NULL url has no header. A NULL page_id never
    is the smallest; where there is no other, every copy is a response. Rows that
    repeat the smallest page_id are responses, too.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).select(
        "*",
        base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("bigint").alias("size"),
    )
    # Only (digest, id) is aggregated, in the map tasks first; the join is inner,
    # so adaptive execution can split a payload with very many copies.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(first, "digest")
    revisits = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisits, urn("first_id")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("size").cast("string").alias("payload_length"),
        F.lit("text/html").alias("content_type"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of all archives below ``path``; payloads only if ``columns`` has them."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def page_id(urn: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(urn), r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
