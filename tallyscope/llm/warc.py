"""Operator 6: WARC archives as a Spark data source, written and read.

Reading plans partitions of files by size, parses a record's headers first, and
skips payloads of records that pushed filters reject or nobody asked for. Writing
rolls files over by size and lists what was committed, so files of lost tasks do
not count. Storage is whatever ``pyarrow.fs`` opens by URI.

Damage never ends a job or passes in silence: a row's ``damage`` is NULL for a whole
record and else says what is wrong with it. Reading goes on at the next line that
starts a record, or with the next file where a compressed one breaks off.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

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
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tallyscope.functions.groups import attach
from tallyscope.llm.common import query, ready, table
from tallyscope.session import checkpoint_root, settle

#: Columns and the header that each comes from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = "record_type string, record_id string, date string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, headers map<string,string>, payload binary, damage string"
ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("damage", pa.string())])
WRITTEN = [*HEADERS, "payload_bytes", "payload"]
LISTING = "_committed"
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 64 << 10
#: Longest header line; a longer one is no header.
LINE_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ------------------------------------------------------------------- records


def record_bytes(row: dict) -> bytes:
    """One record. A revisit holds the HTTP headers only, which tell the payload's length."""
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = DATE if column == "date" and row[column] is None else row[column]
        if value is not None:
            # A header is one line.
            lines.append(f"{header}: {quote(value, safe='') if any(c in value for c in chr(10) + chr(13)) else value}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Damaged(ValueError):
    """Bytes that are not what the format puts there."""


def read_headers(f: BinaryIO, kind: bytes = b"WARC/", *, first: bytes = b"", room: int | None = None) -> dict[str, str] | None:
    """Header lines up to the blank one; None at the end of the file.

    ``first`` is a first line that was read before; no more than ``room`` bytes are read.
    """
    def next_line() -> bytes:
        nonlocal room
        line = f.readline(LINE_BYTES if room is None else min(room, LINE_BYTES))
        if len(line) == LINE_BYTES and not line.endswith(b"\n"):
            raise Damaged("header line without an end")
        if room is not None:
            room -= len(line)
        return line

    line = first or next_line()
    while line in (b"\r\n", b"\n"):
        line = next_line()
    if not line:
        return None
    if not line.startswith(kind):
        raise Damaged("no record starts here")
    headers: dict[str, str] = {}
    name = None
    while (line := next_line()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:  # a folded line goes on with the one before
            headers[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            headers[name] = value.strip()
    return headers


def _value(headers: dict[str, str], name: str) -> str | None:
    if name in headers:
        return headers[name]
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def _length(headers: dict[str, str]) -> int | None:
    text = _value(headers, "Content-Length") or ""
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def _next_start(f: BinaryIO) -> bytes:
    """Read up to the next line that starts a record and return that line; empty at the end of the file."""
    whole = True
    while line := f.readline(LINE_BYTES):
        if whole and line.startswith(b"WARC/"):
            return line
        whole = line.endswith(b"\n")
    return b""


def _damaged(what: str, columns: dict | None = None, skipped: int = 0) -> dict:
    """A row for bytes that hold no readable record; ``payload_bytes`` is how many were passed over."""
    return {**dict.fromkeys(HEADERS), **(columns or {}), "headers": [], "payload": None, "payload_bytes": skipped, "damage": what}


def records(f: BinaryIO, wanted, payload: bool, end: int | None = None) -> Iterator[dict]:
    """Records whose header columns ``wanted`` accepts; the others' blocks are skipped unread.

    ``end`` is the size of the file where it is known. Damage, told in ``damage``: bytes
    between records that start none and records without a length are passed over; a record
    that the file's end cuts off keeps what is left of its payload; the block of a record
    that should hold an HTTP message but doesn't is its payload as a whole.
    """
    first = b""
    while True:
        before = f.tell() - len(first)
        columns: dict = {}
        try:
            headers = read_headers(f, first=first)
            first = b""
            if headers is None:
                return
            columns = {column: _value(headers, header) for column, header in HEADERS.items()}
            size = _length(headers)
            if size is None:
                raise Damaged("no length")
        except Damaged as e:
            first = _next_start(f)
            row = _damaged(str(e), columns, f.tell() - len(first) - before)
            if wanted(row):
                yield row
            if not first:
                return
            continue
        start = f.tell()
        after = start + size if end is None else min(start + size, end)
        if not wanted(columns):
            f.seek(after)
            continue
        row = columns | {"headers": list(headers.items()), "payload": None, "payload_bytes": size, "damage": None}
        if (_value(headers, "Content-Type") or "").startswith("application/http") and size:
            try:
                http = read_headers(f, b"HTTP/", room=size) or {}
                inside = size - (f.tell() - start)
                told = _length(http) if row["record_type"] == "revisit" else None
                row["payload_bytes"] = inside if told is None else told
            except Damaged:
                row["damage"] = "no HTTP message"
                f.seek(start)
        if payload and row["record_type"] != "revisit":
            row["payload"] = f.read(min(row["payload_bytes"], after - f.tell()))
        f.seek(after)
        if f.tell() < start + size:
            row["damage"] = "cut off"
        yield row


# ------------------------------------------------------------------- reading


@dataclass
class Files(InputPartition):
    names: list[str]


def _test(f: Filter):
    """A check of the header columns for a filter that headers decide, else None."""
    name = ".".join(getattr(f, "attribute", ()))
    if name not in HEADERS:
        return None
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda row: row[name] == f.value
    if isinstance(f, In):
        return lambda row: row[name] in f.value
    if isinstance(f, IsNotNull):
        return lambda row: row[name] is not None
    if isinstance(f, StringStartsWith):
        return lambda row: row[name] is not None and row[name].startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda row: row[name] is not None and row[name].endswith(f.value)
    if isinstance(f, StringContains):
        return lambda row: row[name] is not None and f.value in row[name]
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            every = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
            found = [x for x in every if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            listing = [x for x in every if x.base_name.startswith(LISTING)]
            if listing:  # written by this source: only committed files count
                names = set()
                for x in listing:
                    with store.open_input_stream(x.path) as f:
                        names |= set(json.loads(f.read()))
                found = [x for x in found if x.base_name in names]
        plan, size = [], self.partition_bytes
        for x in sorted(found, key=lambda x: x.path):
            if size + x.size > self.partition_bytes:
                plan.append(Files([]))
                size = 0
            plan[-1].names.append(x.path)
            size += x.size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        tests = [_test(f) for f in self.filters]
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw:
                f = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, READ_BYTES)
                for row in self._whole_file(f, None if name.endswith(".gz") else raw.size(), tests):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 1_000
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def _whole_file(self, f: BinaryIO, end: int | None, tests: list) -> Iterator[dict]:
        def wanted(row: dict) -> bool:
            return all(t(row) for t in tests)

        try:
            yield from records(f, wanted, self.payload, end)
        except (EOFError, gzip.BadGzipFile, zlib.error):
            row = _damaged("broken compression")
            if wanted(row):
                yield row


# ------------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}"), 0
                data = record_bytes(row)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{LISTING}-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed job stay unlisted."""


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options path, payload (false: headers only) and partitionBytes.

    ``df.write.format("warc")`` takes the columns of ``WRITTEN``; options path and fileBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --------------------------------------------------------- pages to archives


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32, ten hex digits to eight at a time."""
    hex_ = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hex_, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def to_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages; equal payloads of ``least_bytes`` or more are stored once.

    The row with the largest key is the response, the others revisit it; rows that
    repeat that key are all responses. NULL html is an empty payload, a NULL url
    leaves its header out. A row without a key revisits the others of its payload;
    without any key among them all are responses.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn("_digest", base32_sha1(F.col("payload")))
    large = F.col("payload_bytes") >= least_bytes
    groups = rows.where(large).groupBy("_digest").agg(F.max("_key").alias("_original"), F.count(F.lit(1)).alias("_n"))
    shared = settle(groups.where("_n > 1 AND _original IS NOT NULL").drop("_n"))
    rows = attach(rows, shared, "_digest")
    revisit = large & F.col("_original").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_original"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("_key").alias("record_id"),
        F.lit(None).cast("string").alias("date"),
        "target_uri",
        F.concat(F.lit("sha1:"), "_digest").alias("payload_digest"),
        F.when(revisit, urn("_original")).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    rows.select(*WRITTEN).write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


CHECK = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, payload, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM h),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT)
  + 1, 1)), '') AS digest FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM d
"""


@query("op6_warc", CHECK)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records, written and read back; digests of stored payloads are taken anew."""
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(to_records(table(spark, folder, "pages")), path)
    back = read_warc(spark, path)

    def number(c: str) -> Column:
        return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")

    stored = F.when(F.col("record_type") == "response", base32_sha1(F.coalesce("payload", F.lit(b""))))
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(stored, F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
