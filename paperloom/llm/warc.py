"""WARC archives as a Python data source: ``spark.read.format("warc")`` and a writer.

Reading plans file ranges of ``splitBytes``, takes filters on record type, ids and target
address, parses a record's headers first, and neither inflates nor decodes the payload of a
record that the filters refuse (or of any, with option ``payload`` = ``false``). A gzip
member that this writer made says its length in an extra field, so unwanted payloads are
skipped and large files are cut anywhere between members; archives of other writers are read
one file a task.

Writing makes one gzip member per record and a new file every ``fileBytes``. A task's files
have names of their own attempt; the commit lists those of successful tasks in a manifest,
and reading goes by the manifest, so lost or repeated attempts leave no records behind. Paths
may be of any file system that Arrow opens.

``with_revisits`` decides which records of equal payloads are kept once: payloads of at
least ``least`` bytes that several records share stay in the one with the largest id; the
others become revisits that refer to it. Null payloads are empty. Of records that share the
largest id too, all are responses. Where all ids of a payload are null, all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, "
    "content_type string, payload_digest string, payload_bytes long, payload binary"
)
#: Header of each column that filters can be pushed to.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
MANIFEST = "_manifest.json"
GZIP = b"\x1f\x8b\x08"
#: Start of a member with our extra field: flags, no time, 12 extra bytes, field "WL" of 8.
OWN = GZIP + b"\x04\x00\x00\x00\x00\x00\xff\x0c\x00WL\x08\x00"
HEAD = len(OWN) + 8
SPLIT_BYTES = 64 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(raw: bytes) -> bytes:
    """One gzip member that knows its own length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return OWN + struct.pack("<Q", HEAD + len(body) + 8) + body + tail


def record(row: dict) -> bytes:
    """A record in WARC 1.1: an HTTP response, whose body a revisit leaves out."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type']}\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['warc_date']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", row["target_uri"]))
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{row['refers_to']}>")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode() + payload + b"\r\n\r\n"


def fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is the version or status."""
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


@dataclass
class Filters:
    equal: list[tuple[str, frozenset]] = field(default_factory=list)
    prefix: list[tuple[str, str]] = field(default_factory=list)

    def accept(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.equal) and all(
            (row[c] or "").startswith(start) for c, start in self.prefix
        )


class Stream:
    """Bytes of a file from a place on, read ahead in blocks; places are absolute."""

    def __init__(self, file, at: int):
        self.file, self.at, self.buffer = file, at, b""

    def peek(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.file.seek(self.at + len(self.buffer))
            self.buffer += self.file.read(max(READ_BYTES, n - len(self.buffer)))
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.skip(n)
        return got


def head_of(text: bytes) -> dict:
    """The columns that a record's own headers give."""
    h = fields(text)
    row = {column: h.get(name) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            row[column] = row[column].removeprefix("<").removesuffix(">")
    digest = h.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and len(digest) == 37:
        digest = base64.b32decode(digest[5:]).hex()
    row |= {"payload_digest": digest.removeprefix("sha1:") or None, "length": int(h.get("content-length", 0))}
    return row


def finished(row: dict, block: bytes) -> dict:
    """Adds the payload: the HTTP body, or the block of other records. A revisit's stays null;
    its size is that of the response it stands for."""
    if (row["content_type"] or "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        own = fields(http)
        row["content_type"] = own.get("content-type")
    else:
        own, body = {}, block
    if row["record_type"] == "revisit":
        said = own.get("content-length", "")
        return row | {"payload": None, "payload_bytes": int(said) if said.isdigit() else None}
    return row | {"payload": body, "payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest()}


def members(stream: Stream, end: int | None) -> Iterator[tuple[bytes | None, int]]:
    """(compressed member, its length) from members that begin before ``end``; our own."""
    while (end is None or stream.at < end) and (head := stream.peek(HEAD)):
        if not head.startswith(OWN):
            raise ValueError(f"no record at byte {stream.at}")
        yield head, struct.unpack("<Q", head[-8:])[0]


def own_records(stream: Stream, end: int, filters: Filters, payload: bool) -> Iterator[dict]:
    for _, length in members(stream, end):
        inflate = zlib.decompressobj(-15)
        text, used = b"", HEAD
        while b"\r\n\r\n" not in text and used < length - 8:
            piece = stream.peek(min(used + 2048, length - 8))[used:]
            used += len(piece)
            text += inflate.decompress(piece)
        row = head_of(text.partition(b"\r\n\r\n")[0])
        if filters.accept(row):
            if payload or row["record_type"] == "revisit":
                text += inflate.decompress(stream.peek(length - 8)[used:]) + inflate.flush()
                yield finished(row, text.partition(b"\r\n\r\n")[2][: row["length"]])
            else:
                yield row | {"payload": None, "payload_bytes": None}
        stream.skip(length)


class Inflated:
    """A file of plain or of any gzip records, as one stream of bytes."""

    def __init__(self, stream: Stream):
        self.stream, self.buffer = stream, b""
        self.gzip = stream.peek(3) == GZIP
        self.inflate = zlib.decompressobj(31)

    def fill(self) -> bool:
        if not self.gzip:
            piece = self.stream.take(READ_BYTES)
            self.buffer += piece
            return bool(piece)
        while True:
            piece = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            piece = piece or self.inflate.unconsumed_tail or self.stream.take(READ_BYTES)
            if not piece:
                return False
            made = self.inflate.decompress(piece, 4 * READ_BYTES)
            if made:
                self.buffer += made
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.buffer:
            if not self.fill():
                return None
        found, _, self.buffer = self.buffer.partition(mark)
        return found

    def take(self, n: int, keep: bool) -> bytes:
        if not self.gzip and not keep and n > len(self.buffer):
            self.stream.skip(n - len(self.buffer))
            self.buffer = b""
            return b""
        out = []
        while n > 0 and (self.buffer or self.fill()):
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            if keep:
                out.append(piece)
        return b"".join(out)


def other_records(stream: Stream, filters: Filters, payload: bool) -> Iterator[dict]:
    source = Inflated(stream)
    while (text := source.until(b"\r\n\r\n")) is not None:
        text = text.lstrip(b"\r\n")
        if not text:
            continue
        if not text.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        row = head_of(text)
        wanted = filters.accept(row)
        decode = wanted and (payload or row["record_type"] == "revisit")
        block = source.take(row["length"], decode)
        if wanted:
            yield finished(row, block) if decode else row | {"payload": None, "payload_bytes": None}


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.filters = Filters()

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in HEADERS and column != "content_type" and isinstance(f, EqualTo):
                self.filters.equal.append((column, frozenset([f.value])))
            elif column in HEADERS and column != "content_type" and isinstance(f, In):
                self.filters.equal.append((column, frozenset(f.value)))
            elif column in HEADERS and column != "content_type" and isinstance(f, StringStartsWith):
                self.filters.prefix.append((column, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            listed = files.get_file_info(fs.FileSelector(root, recursive=True))
            manifest = [i for i in listed if i.path.rstrip("/") == f"{root.rstrip('/')}/{MANIFEST}"]
            names = None
            if manifest:
                with files.open_input_stream(manifest[0].path) as f:
                    names = set(json.load(f))
            found = [
                i
                for i in listed
                if i.type == fs.FileType.File
                and i.base_name.endswith((".warc", ".warc.gz"))
                and (names is None or i.base_name in names)
            ]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            if i.size > self.split:
                with files.open_input_file(i.path) as f:
                    whole = f.read(len(OWN)) != OWN
            else:
                whole = True
            cuts = [0] if whole else list(range(0, i.size, self.split))
            out += [Range(i.path, b, e) for b, e in zip(cuts, [*cuts[1:], i.size], strict=True) if i.size]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without records
            return
        files, _ = opened(self.path)
        kinds = {n: pa.string() for n in self.columns} | {"payload": pa.binary(), "payload_bytes": pa.int64()}
        schema = pa.schema([(n, kinds[n]) for n in self.columns])
        with files.open_input_file(partition.path) as file:
            stream = Stream(file, partition.begin)
            if partition.begin:  # on to the first member that begins in this range
                while (place := stream.peek(READ_BYTES).find(OWN)) < 0 and len(stream.buffer) > len(OWN):
                    stream.skip(len(stream.buffer) - len(OWN))
                if place < 0:
                    return
                stream.skip(place)
            if stream.peek(len(OWN)) == OWN:
                rows = own_records(stream, partition.end, self.filters, self.payload)
            else:
                rows = other_records(stream, self.filters, self.payload)
            ready, size = [], 0
            for row in rows:
                ready.append({n: row.get(n) for n in self.columns})
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.size:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                raw = member(record(row))
                out.write(raw)
                size += len(raw)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        manifest = f"{root}/{MANIFEST}"
        if not self.overwrite and files.get_file_info(manifest).type == fs.FileType.File:
            with files.open_input_stream(manifest) as f:
                names += json.load(f)
        with files.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps(names).encode())
        files.move(f"{manifest}.new", manifest)

    def abort(self, messages) -> None:
        files, root = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            files.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Write records with the columns of SCHEMA, in any order; others are left out."""
    register(records.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    records.select(*columns).write.format("warc").options(**options).mode("append").save(path)


def with_revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """``records`` (record_id, key, payload, ...) with payload_digest, payload_bytes, record_type
    and refers_to; ``key`` orders the ids.

    Only digests are grouped. The join on them has the payloads on its left, where Spark can
    split a digest that many records share.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    known = records.withColumns(
        {"payload_digest": F.sha1(payload), "payload_bytes": F.octet_length(payload).cast("long")}
    )
    shared = (
        known.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max(F.struct("key", "record_id")).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first.key is not null")
        .select("payload_digest", "first")
    )
    revisit = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    return known.join(shared, "payload_digest", "left").withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("first.record_id")),
            "payload": F.when(~revisit, F.col("payload")),
        }
    ).drop("first")
