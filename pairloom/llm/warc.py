"""WARC archives as a PySpark data source, and deduplicated writing of pages to them.

Files are WARC/1.1 with one gzip member per record. Each member carries its compressed and its plain length in the
gzip extra field ``sl``, so a reader inflates the headers first and jumps over a record that a predicate rejects.
Archives of other writers are read too: members without that field (or with lengths that cannot be right), several
records a member, plain ``.warc`` files, and all record types. There the reader goes from record to record by
Content-Length; in plain files it jumps over what is not wanted, in compressed ones it inflates and drops it.
The reader plans one partition per file (the writer starts a new file at ``maxFileBytes``), takes predicates on
record_type, record_id, refers_to and target_uri, and decodes payloads only if the schema asks for them.

Options: ``path`` (a folder or one file); when writing ``maxFileBytes``; when reading ``verify`` (true: recompute the
digest of every payload that has a SHA-1 in its header and raise if it differs).

The payload of a record with HTTP content is what follows the HTTP headers, without undoing transfer or content
encodings (payloads under a transfer encoding are not verified); of other records it is the whole block; a revisit has
none. Its length is that of the header X-Payload-Length, else counted; a record without a digest has a null one.
A file that is no archive or ends within a record raises ValueError or EOFError.

Null payloads count as empty. A null target has no header and is read back as null. Payloads may be of any length that
Arrow holds; one is in memory at a time, with a batch of 4 MB. Repeated pages become records each, ties in the key are
responses alike (``page_records``); empty tables and folders without archives give an empty result. Other columns
of the pages are not read, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from pairloom.llm.tables import shared_folder, stage

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes bigint, payload binary"
)
# fixed values of the format
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER_HEAD = "<4BIBBH2sHII"  # with the extra field: id, its length, compressed and plain length
BLANK_LINES = (b"\r\n", b"\n", b"")  # the last is the end of the file
MAX_FILE_BYTES = 128 << 20
ARROW_TYPES = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record. A revisit has no payload, but names its digest and length."""
    body = HTTP_HEAD if row["record_type"] == "revisit" else HTTP_HEAD + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}",
    ]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + "".join(row["target_uri"].splitlines()))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{row['payload_digest'] or digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(plain: bytes, most: int = (1 << 32) - 1) -> bytes:
    """A gzip member with the lengths of the record in its extra field, which holds 32 bits of each: a record beyond
    ``most`` bytes goes without."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    whole = struct.calcsize(MEMBER_HEAD) + len(body) + 8
    if max(whole, len(plain)) > most:
        head = struct.pack("<4BIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255)
        return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    head = struct.pack(MEMBER_HEAD, 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, whole, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class ArchiveFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.path, self.verify = options["path"], options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with text on a header is decided here; anything else is left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_bytes" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name == "record_type"):  # every record has a type
                yield f

    def partitions(self) -> list[ArchiveFile]:
        system, folder = _opened(self.path)
        if system.get_file_info(folder).type == fs.FileType.File:
            return [ArchiveFile(folder)]
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        archives = [f.path for f in found if f.base_name.endswith((".warc.gz", ".warc")) and f.base_name[0] != "."]
        return [ArchiveFile(path) for path in sorted(archives)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in self.fields]
        schema = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in self.fields])
        if partition is None:  # no file at all
            return
        rows, held = [], 0
        for row in records(_opened(self.path)[0], partition.path, self.wanted, "payload" in names, self.verify):
            rows.append({name: row.get(name) for name in names})
            held += len(row.get("payload") or b"") + 200
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


def _parsed(head: bytes, path: str) -> dict:
    if not head.startswith(b"WARC/"):
        raise ValueError(f"{path}: no WARC record at {head[:40]!r}")
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        if line[:1] in (" ", "\t") and lines:  # a header that goes on
            lines[-1] += " " + line.strip()
        else:
            lines.append(line.rstrip("\r"))
    named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    row = {field: named.get(header.lower()) for field, header in HEADERS.items()}
    for field in ("record_id", "refers_to"):
        row[field] = row[field] and row[field].removeprefix("<").removesuffix(">")
    algorithm, _, digest = (row["payload_digest"] or "").rpartition(":")
    row["sha1"] = algorithm.lower() in ("", "sha1")
    row["payload_digest"] = digest or None
    row["payload_bytes"] = None if row["payload_bytes"] is None else int(row["payload_bytes"])
    row["content_length"] = int(named.get("content-length") or 0)
    row["http"] = named.get("content-type", "").lower().startswith("application/http")
    return row


def _needs_block(row: dict, payload: bool, verify: bool) -> bool:
    return row["record_type"] != "revisit" and (payload or verify or row["payload_bytes"] is None)


def _take_block(row: dict, block: BinaryIO, payload: bool, verify: bool, path: str) -> int:
    """Fill in what the block tells; how many of its bytes were read."""
    left, encoded = row["content_length"], False
    while row["http"] and left:
        line = block.readline(left)
        left -= len(line)
        encoded |= line.lower().startswith(b"transfer-encoding:")
        if line in BLANK_LINES:
            break
    if payload or verify:
        body = block.read(left)
        if len(body) < left:
            raise ValueError(f"{path}: record {row['record_id']} ends early")
        if verify and row["sha1"] and row["payload_digest"] and not encoded:
            sha1 = hashlib.sha1(body)
            same = row["payload_digest"] in (base64.b32encode(sha1.digest()).decode(), sha1.hexdigest())
            if not same or row["payload_bytes"] not in (None, left):
                raise ValueError(f"{path}: the payload of {row['record_id']} does not match its digest")
        row["payload"] = body
    row["payload_bytes"] = left if row["payload_bytes"] is None else row["payload_bytes"]
    return row["content_length"] - (0 if payload or verify else left)


def _rejected(row: dict, wanted: dict) -> bool:
    return any(row[name] not in values for name, values in wanted.items())


def _one_after_another(
    stream: BinaryIO, path: str, wanted: dict, payload: bool, verify: bool, end: int | None
) -> Iterator[dict]:
    """The wanted records of a plain stream, which ends at ``end`` if that is known."""
    while line := stream.readline():
        if not line.strip():  # between records
            continue
        head = line
        while (line := stream.readline()) not in BLANK_LINES:
            head += line
        row = _parsed(head, path)
        start, read = stream.tell(), 0
        own = not _rejected(row, wanted)
        if own and _needs_block(row, payload, verify):
            read = _take_block(row, stream, payload, verify, path)
        after = start + row["content_length"]
        if read < row["content_length"] and (stream.seek(after) != after or (end is not None and after > end)):
            raise ValueError(f"{path}: record {row['record_id']} ends early")
        if own:
            yield row


def _lengths(head: bytes, at: int, end: int) -> int:
    """The compressed length that a member's extra field gives; 0 without one that can be right."""
    size = struct.calcsize(MEMBER_HEAD)
    if len(head) < size:
        return 0
    one, two, method, flags, *_, extra, name, length, compressed, _ = struct.unpack(MEMBER_HEAD, head)
    known = (one, two, method, flags, extra, name, length) == (0x1F, 0x8B, 8, 4, 12, b"sl", 8)
    return compressed if known and size + 8 < compressed <= end - at else 0


def records(system: fs.FileSystem, path: str, wanted: dict, payload: bool, verify: bool) -> Iterator[dict]:
    """The records of a file that the predicates accept. Where members carry their length, headers are inflated first and
    the rest of a member only if something of it is asked for. From the first member without it on, and in plain
    files, records are read one after another."""
    with system.open_input_file(path) as source:
        at, end = 0, source.size()
        if not path.endswith(".gz"):
            yield from _one_after_another(io.BufferedReader(source, 1 << 20), path, wanted, payload, verify, end)
            return
        while at < end:
            source.seek(at)
            compressed = _lengths(source.read(struct.calcsize(MEMBER_HEAD)), at, end)
            if not compressed:
                source.seek(at)
                with gzip.GzipFile(fileobj=io.BufferedReader(source, 1 << 20)) as plain:
                    yield from _one_after_another(plain, path, wanted, payload, verify, None)
                return
            inflate, plain = zlib.decompressobj(-15), b""
            left = compressed - struct.calcsize(MEMBER_HEAD) - 8
            while (cut := plain.find(b"\r\n\r\n")) < 0 and left:
                piece = source.read(min(left, 2048))
                if not piece:
                    raise EOFError(f"{path} ends within a record")
                left -= len(piece)
                plain += inflate.decompress(piece)
            at += compressed
            row = _parsed(plain[:cut] if cut >= 0 else plain, path)
            if _rejected(row, wanted):
                continue
            if _needs_block(row, payload, verify):
                plain += inflate.decompress(source.read(left)) if left else b""
                _take_block(row, io.BytesIO(plain[cut + 4 :]), payload, verify, path)
            yield row


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files; the commit gives them their names, so a lost attempt leaves nothing behind."""

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("maxfilebytes") or options.get("maxFileBytes") or MAX_FILE_BYTES)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        names, sink, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    sink, size = system.open_output_stream(posixpath.join(folder, f".{names[-1]}"), compression=None), 0
                payload = row["payload"] or b""
                packed = member(record(row, payload.encode() if isinstance(payload, str) else payload))
                sink.write(packed)
                size += len(packed)
                if size >= self.most:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for name in [name for message in messages if message for name in message.names]:
            system.move(posixpath.join(folder, f".{name}"), posixpath.join(folder, f"part-{name}"))

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for name in [name for message in messages if message for name in message.names]:
            system.delete_file(posixpath.join(folder, f".{name}"))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


RECORD_PREFIX = "urn:page:"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0):
    """Pages as records. Of equal payloads of at least ``least`` bytes, the one with the smallest key is the response
    and the others revisit it. Rows that repeat this smallest key are responses too; null keys come last, and are
    responses if the payload has no other key. Equal means an equal SHA-256.

    Only payloads that occur twice or more are joined back, as a staged table of (digest, smallest key)."""
    body = F.coalesce(F.col(html), F.lit(""))
    pages = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("target_uri"), body.alias("body"))
    same = F.sha2(F.encode("body", "UTF-8"), 256)
    narrow = pages.where(F.octet_length("body") >= least).select("key", same.alias("same"))
    groups = narrow.groupBy("same").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stage(groups.select("same", "first"), "warc-first")
    marked = pages.withColumn("same", same).join(groups, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit(RECORD_PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("key").alias("record_id"),
        F.when(revisit, name("first")).alias("refers_to"),
        "target_uri",
        F.lit(None).cast("string").alias("payload_digest"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.encode("body", "UTF-8").alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, least: int = 0, max_file_bytes: int = MAX_FILE_BYTES) -> None:
    register(pages.sparkSession)
    page_records(pages, least=least).write.format("warc").mode("append").options(
        path=path, maxFileBytes=str(max_file_bytes)
    ).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    schema = SCHEMA if payload else SCHEMA.removesuffix(", payload binary")
    return spark.read.format("warc").schema(schema).options(path=path, verify=str(verify).lower()).load()


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, read the archives back with every payload checked against its digest, one row per page."""
    path = f"{shared_folder(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    write_pages(pages, path, least)
    key = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(key(c) != "", key(c).cast("long"))
    return read_archives(pages.sparkSession, path, payload=False, verify=True).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS least FROM pages_)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(flatten(list_transform([1, 11, 21, 31], lambda a: list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, a, 10) AS BIGINT) >> b) & 31) + 1 AS INTEGER), 1)))), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM first
"""
