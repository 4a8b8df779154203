"""WARC archives as a Spark data source.

Reading plans partitions from files, takes record-type and header predicates, parses a record's header
first and skips what is not wanted: in ``.warc.gz`` members that carry their size, and in plain ``.warc``
by the content length, the bytes are not even read. Memory follows the largest wanted record.

Writing makes one archive per task (a new one every ``file_bytes``), a gzip member per record. The files
of finished tasks are listed in a manifest when the job commits, so what lost or repeated tasks left is
never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, content_length bigint, payload_digest string, "
    "refers_to string, headers map<string,string>, http_headers map<string,string>, payload binary"
)
# The header that holds each column.
HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
MANIFEST = "_manifest-"  # a list of files for each finished job
HEAD = 16 << 10
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- Writing ----


def _line(name: str, value: str | None) -> bytes:
    if value is None:
        return b""
    clean = value.replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {clean}\r\n".encode()


def record_bytes(row: dict) -> bytes:
    """One record. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\n" + _line("Content-Type", row.get("media_type") or "text/html; charset=utf-8") + _line("Content-Length", str(len(payload))) + b"\r\n"
    if not revisit:
        block += payload
    head = b"WARC/1.1\r\n" + b"".join((
        _line("WARC-Type", row["record_type"]), _line("WARC-Record-ID", f"<{row['record_id']}>"), _line("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"),
        _line("WARC-Target-URI", row.get("target_uri")), _line("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        _line("WARC-Refers-To", f"<{row['refers_to']}>" if revisit and row.get("refers_to") is not None else None),
        _line("WARC-Profile", IDENTICAL if revisit else None),
        _line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", str(len(block))),
    ))
    return head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member; its extra field ``sl`` holds both sizes, so that a reader can step over it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 14 + len(body) + 8
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, size, len(record)) if size < 1 << 32 and len(record) < 1 << 32 else struct.pack("<H", 12) + bytes(12)
    return struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for row in iterator:
            if out is None or size >= self.file_bytes:
                if out is not None:
                    out.close()
                files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
            data = member(record_bytes(row.asDict()))
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """List this job's files; a job that overwrites then forgets the lists of those before it, and their files."""
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        older = _manifests(system, folder) if self.overwrite else []
        with system.open_output_stream(f"{folder}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        for path in older:
            names = _listed(system, path)
            system.delete_file(path)
            for name in names:
                system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Without a manifest nothing of the job is read."""


def _manifests(system: pafs.FileSystem, folder: str) -> list[str]:
    return [x.path for x in system.get_file_info(pafs.FileSelector(folder)) if x.base_name.startswith(MANIFEST)]


def _listed(system: pafs.FileSystem, path: str) -> list[str]:
    with system.open_input_stream(path, compression=None) as source:
        return json.loads(source.read())


# ---- Reading ----


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 128 << 20)))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", IsNotNull: "there"}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER and type(f) in kinds:
                self.filters.append((HEADER[column], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.filters:
            own = _value(headers, name)
            if own is None or kind == "equal" and own != value or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Whole files, several small ones together; with manifests, only the files they list."""
        system, folder = _file_system(self.path)
        info = system.get_file_info(folder)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = [x for x in system.get_file_info(pafs.FileSelector(folder, recursive=True)) if x.base_name.endswith((".warc", ".warc.gz"))]
            manifests = _manifests(system, folder)
            if manifests:
                names = {name for m in manifests for name in _listed(system, m)}
                found = [x for x in found if x.base_name in names]
        groups, size = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not groups or size + x.size > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as source:
                yield from (self._zipped if path.endswith(".gz") else self._plain)(source)

    def _row(self, headers: dict[str, str], block: bytes) -> tuple:
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            top, gap, payload = block.partition(b"\r\n\r\n")
            http = _fields(top)
        revisit = headers.get("warc-type") == "revisit"
        declared = _value(headers, "warc-payload-digest")
        if self.verify and self.payload and not revisit and declared is not None and declared != digest(payload):
            raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its digest")
        columns = [_value(headers, HEADER[c]) for c in ("record_id", "record_type", "target_uri", "date", "content_type")]
        return (*columns, int(headers["content-length"]), declared, _value(headers, "warc-refers-to"), headers, http, payload if self.payload and not revisit else None)

    def _plain(self, source) -> Iterator[tuple]:
        at, end = 0, source.size()
        while at < end:
            source.seek(at)
            head = b""
            while b"\r\n\r\n" not in head.lstrip(b"\r\n"):
                more = source.read(HEAD)
                if not more:
                    break
                head += more
            text = head.lstrip(b"\r\n")
            if not text:
                return
            at += len(head) - len(text)
            top, gap, _ = text.partition(b"\r\n\r\n")
            if not gap:
                raise ValueError(f"record at byte {at} has no end of header")
            headers = _fields(top)
            begin, length = at + len(top) + 4, int(headers["content-length"])
            if self.wanted(headers):
                source.seek(begin)
                yield self._row(headers, source.read(length) if self.payload else _top(source.read, length))
            at = begin + length + 4

    def _zipped(self, source) -> Iterator[tuple]:
        at, end = 0, source.size()
        while at < end:
            source.seek(at)
            raw = source.read(HEAD)
            if raw[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {at}")
            size = _member_size(raw)
            inflate, text = zlib.decompressobj(31), b""
            text, raw = inflate.decompress(raw, HEAD), inflate.unconsumed_tail
            read = at + HEAD
            while b"\r\n\r\n" not in text and not inflate.eof:
                raw = raw or source.read(HEAD)
                if not raw:
                    break
                text += inflate.decompress(raw, HEAD)
                raw = inflate.unconsumed_tail
            top, gap, body = text.partition(b"\r\n\r\n")
            if not gap:
                raise ValueError(f"record at byte {at} has no end of header")
            headers = _fields(top)
            keep = self.wanted(headers)
            length = int(headers["content-length"])
            if keep and not self.payload and size is not None:  # the HTTP header is all that is wanted of the block
                while b"\r\n\r\n" not in body and len(body) < length and not inflate.eof:
                    raw = raw or source.read(HEAD)
                    if not raw:
                        raise ValueError(f"record at byte {at} is cut off")
                    body += inflate.decompress(raw, HEAD)
                    raw = inflate.unconsumed_tail
                yield self._row(headers, body[:length])
            elif keep or size is None:
                parts = [body]
                while not inflate.eof:
                    raw = raw or source.read(1 << 20)
                    if not raw:
                        raise ValueError(f"record at byte {at} is cut off")
                    out = inflate.decompress(raw, 1 << 20)
                    raw = inflate.unconsumed_tail
                    if keep:
                        parts.append(out)
                if keep:
                    yield self._row(headers, b"".join(parts)[:length])
            at = at + size if size is not None else source.tell() - len(inflate.unused_data)


def _top(read: Callable[[int], bytes], length: int) -> bytes:
    """A block up to the end of its HTTP header, or what there is of it."""
    out = b""
    while b"\r\n\r\n" not in out and len(out) < length:
        more = read(min(HEAD, length - len(out)))
        if not more:
            break
        out += more
    return out


def _member_size(raw: bytes) -> int | None:
    """The size a gzip member states in its extra field, if it does."""
    if not raw[3] & 4:
        return None
    (length,) = struct.unpack_from("<H", raw, 10)
    at, end = 12, 12 + length
    while at + 4 <= end:
        name, (size,) = raw[at:at + 2], struct.unpack_from("<H", raw, at + 2)
        if name == b"sl" and size == 8:
            return struct.unpack_from("<I", raw, at + 4)[0]
        at += 4 + size
    return None


def _fields(top: bytes) -> dict[str, str]:
    """Named fields by lower-case name; the first line is the version or status. Folded lines are joined."""
    fields: dict[str, str] = {}
    name = None
    for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _value(headers: dict[str, str], name: str) -> str | None:
    """A header as the columns show it: ids without angle brackets, digests without their algorithm."""
    value = headers.get(name)
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 256 << 20)), overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of an archive or a folder of archives.

    ``payload=False`` leaves payloads out; ``verify`` compares decoded payloads with their digests.
    A revisit has no payload. A folder without archives gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(payload=str(payload), verify=str(verify)).load(path)


def write_pages(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """A record per page: of equal payloads of ``min_bytes`` or more the one with the least id is the
    response and others revisit it.

    NULL payload is empty; NULL url has no target header. Pages that repeat the least id are responses
    each; a NULL id is revisiting if any other page has the payload, and in ``refers_to`` only ids stand.
    An empty table makes a folder without archives. Other columns are not read.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(bytearray()))
    framed = pages.select(F.col(ident).alias("i"), F.col(url).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("h"))
    first = framed.filter(F.octet_length("payload") >= min_bytes).groupBy("h").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").hint("rebalance")
    judged = framed.join(first.select("h", "least"), "h", "left").withColumn("again", F.col("least").isNotNull() & ~F.col("i").eqNullSafe(F.col("least")))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    records = judged.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), name("i").alias("record_id"),
        "target_uri", F.when(F.col("again"), name("least")).alias("refers_to"), "payload")
    records.write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of archived pages.

    Payloads are read and verified where a record has one; revisits take figures from their headers.
    """
    page = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), '') AS BIGINT)")
    columns = [page("record_id").alias("page_id")], ["payload_digest", "record_type", page("refers_to").alias("refers_to")]
    full = read_warc(spark, path, verify=True).filter("record_type = 'response'").select(*columns[0], F.octet_length("payload").cast("long").alias("payload_bytes"), *columns[1])
    again = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(*columns[0], F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), *columns[1])
    return full.union(again)
