"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import materialize

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
EPOCH = "1970-01-01T00:00:00Z"
#: Length of the full payload, which a revisit record does not hold (an own field, as the format allows).
PAYLOAD_LENGTH = "WARC-Payload-Length"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, "
    "content_length long, headers map<string,string>, payload_bytes long, payload_digest string, digest_ok boolean, "
    "payload binary"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "content_type", "refers_to")]
    + [
        ("content_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("digest_ok", pa.bool_()),
        ("payload", pa.binary()),
    ]
)
#: Columns whose value stands in the record header, so that a predicate needs no payload.
_HEADER_COLUMNS = {*FIELDS, "content_length"}


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; ``file:/x`` as Hadoop writes it is understood too."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


# ---------------------------------------------------------------- writing


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP head of its block but not the payload."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    block, content = payload, row.get("content_type") or "application/octet-stream"
    if kind in ("response", "revisit"):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: {_field(content)}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = head + payload if kind == "response" else head
        content = "application/http; msgtype=response"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": row.get("date") or EPOCH,
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        PAYLOAD_LENGTH: str(len(payload)),
        "Content-Type": content,
        "Content-Length": str(len(block)),
    }
    lines = [VERSION] + [f"{k}: {_field(v)}".encode() for k, v in fields.items() if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member of its own, with the skip lengths of the format's annex in its extra field."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of about ``file_bytes``; they get their names once all tasks are done.

    Files of failed attempts stay in ``_temporary`` and go with it, so a lost executor leaves nothing behind.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.level = int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/_temporary/{files[-1]}", compression=None), 0
                data = member(record({n: c[i].as_py() for n, c in columns.items()}), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        if store.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary")


# ---------------------------------------------------------------- reading


def parse_head(data: bytes) -> dict[str, str]:
    """Fields of a record header, by lower-case name; the first of a repeated one counts."""
    fields: dict[str, str] = {}
    name = None
    for line in data.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            name = key.strip().decode("utf-8", "replace").lower()
            fields.setdefault(name, value.strip().decode("utf-8", "replace"))
    return fields


class Entry:
    """A record of which only the header has been read; ``block()`` reads the rest, ``skip()`` goes past it."""

    def __init__(self, fields: dict[str, str], block, skip) -> None:
        self.fields, self.block, self.skip = fields, block, skip


def _plain_entries(file: io.BufferedReader) -> Iterator[Entry]:
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {file.tell() - len(line)}")
        head = [line.rstrip(b"\r\n")]
        while (line := file.readline().rstrip(b"\r\n")):
            head.append(line)
        fields = parse_head(b"\r\n".join(head))
        length = int(fields.get("content-length", 0))
        end = file.tell() + length
        yield Entry(fields, lambda n=length: file.read(n), lambda: None)
        file.seek(end)


def _gzip_entries(file: io.BufferedReader, step: int = 1 << 14) -> Iterator[Entry]:
    """One entry per gzip member. With skip lengths an unwanted member is passed by a seek, not decompressed."""
    while True:
        start = file.tell()
        head = file.read(24)
        if not head:
            return
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        total = None
        if head[3] & 4 and head[12:16] == b"sl\x08\0":
            total = struct.unpack("<I", head[16:20])[0]
        unpack = zlib.decompressobj(31)
        text = unpack.decompress(head)
        while b"\r\n\r\n" not in text and not unpack.eof:
            if not (chunk := file.read(step)):
                break
            text += unpack.decompress(chunk)
        cut = text.find(b"\r\n\r\n")
        if cut < 0 or not text.startswith(b"WARC/"):
            raise ValueError(f"no WARC record in the gzip member at byte {start}")
        fields = parse_head(text[:cut])
        length = int(fields.get("content-length", 0))

        def block(text=text, cut=cut, length=length, unpack=unpack) -> bytes:
            parts, have = [text[cut + 4 :]], len(text) - cut - 4
            while have < length and not unpack.eof:
                if not (chunk := file.read(step)):
                    raise ValueError("a record ends early")
                parts.append(unpack.decompress(chunk))
                have += len(parts[-1])
            return b"".join(parts)[:length]

        def skip(unpack=unpack) -> None:  # without skip lengths the stream itself tells where it ends
            while not unpack.eof:
                if not (chunk := file.read(step)):
                    break
                unpack.decompress(chunk)
            file.seek(file.tell() - len(unpack.unused_data))

        yield Entry(fields, block, skip)
        if total:
            file.seek(start + total)
        else:
            skip()


def entries(file: io.BufferedReader) -> Iterator[Entry]:
    """Records of a plain or a gzipped archive in their order."""
    return _gzip_entries(file) if file.peek(2)[:2] == b"\x1f\x8b" else _plain_entries(file)


def _holds(test: Filter, value) -> bool:
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, GreaterThan):
        return value > test.value
    if isinstance(test, GreaterThanOrEqual):
        return value >= test.value
    if isinstance(test, LessThan):
        return value < test.value
    if isinstance(test, LessThanOrEqual):
        return value <= test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, StringEndsWith):
        return value.endswith(test.value)
    if isinstance(test, StringContains):
        return test.value in value
    return True


_KNOWN = (
    IsNull, IsNotNull, EqualNullSafe, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual,
    StringStartsWith, StringEndsWith, StringContains,
)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    """Whole files are dealt to partitions of about ``partition_bytes``; headers are parsed before payloads."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partition_bytes", 8 << 20))
        self.payload = options.get("payload", "bytes")
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError("payload is one of bytes, digest, none")
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            column = test.attribute if isinstance(test, _KNOWN) else ()
            if len(column) == 1 and column[0] in _HEADER_COLUMNS:
                self.tests.append((column[0], test))
            else:
                yield test

    def partitions(self) -> list[Files]:
        store, root = file_system(self.path)
        found = store.get_file_info(root)
        infos = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root))
        files = sorted(
            (f.size, f.path) for f in infos
            if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and f.size
        )
        parts: list[Files] = []
        held, size = [], 0
        for bytes_, path in files:
            if held and size + bytes_ > self.partition_bytes:
                parts.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += bytes_
        return parts + [Files(held)] if held else parts or [Files([])]

    def _row(self, entry: Entry) -> tuple | None:
        fields = entry.fields
        values = {c: fields.get(n.lower()) for c, n in FIELDS.items()}
        values["content_length"] = int(fields.get("content-length", 0))
        if not all(_holds(test, values[c]) for c, test in self.tests):
            return None
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = int(fields[PAYLOAD_LENGTH.lower()]) if PAYLOAD_LENGTH.lower() in fields else None
        found, ok, payload = told, None, None
        if self.payload != "none" and values["record_type"] != "revisit":
            payload = entry.block()
            if (values["content_type"] or "").startswith("application/http"):
                head, _, body = payload.partition(b"\r\n\r\n")
                kind = re.search(rb"(?im)^content-type:[ \t]*(.*?)\r?$", head)
                values["content_type"] = kind[1].decode("utf-8", "replace") if kind else values["content_type"]
                payload = body
            length, found = len(payload), digest(payload)
            ok = told is None or told == found
        shown = payload if self.payload == "bytes" else None
        return (
            values["record_id"], values["record_type"], values["target_uri"], values["date"], values["content_type"],
            values["refers_to"], values["content_length"], list(fields.items()), length, found, ok, shown,
        )

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW
            )
            rows.clear()
            return batch

        for path in partition.paths:
            with io.BufferedReader(store.open_input_file(path), 1 << 18) as file:
                for entry in entries(file):
                    row = self._row(entry)
                    if row is None:
                        continue
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield flush()
                        size = 0
        if rows:
            yield flush()


class WarcSource(DataSource):
    """Options: ``path``; reading ``payload`` (``bytes``, ``digest``: only checked, ``none``) and
    ``partition_bytes``; writing ``file_bytes`` and ``level``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of ``pages(page_id, url, html)``: equal payloads of at least ``least_bytes`` are stored once.

    The payload is the html in UTF-8 (null: empty). Of equal payloads (by SHA-256) the
    one with the smallest page_id becomes a response, the others revisits that refer to
    it. Only digests that repeat are joined back, so the join can be split on a hot
    payload and needs no shuffle of pages while the repeated digests are few. A page_id
    on several rows is one page, written once per row; a null one counts as the largest.
    """
    rows = pages.select(
        "page_id", F.col("url").alias("target_uri"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    key = F.sha2("payload", 256)
    repeated = materialize(
        rows.where(F.length("payload") >= least_bytes)
        .groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("key", "first"),
        "repeated-payloads",
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    long_enough = F.length("payload") >= least_bytes
    return rows.withColumn("key", F.when(long_enough, key)).join(repeated, "key", "left").select(
        urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(later, urn(F.col("first"))).alias("refers_to"),
        "payload",
    )


def page_id(urn) -> Column:
    """The page id in a record id of :func:`page_records`."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
