"""WARC archives: a Spark data source that reads headers first, and a writer that deduplicates payloads."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import Workspace

VERSION = b"WARC/1.1"
#: A writer starts another file after so many bytes, so no reader's task is larger.
FILE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
SUBFIELD = b"sl"  # skip lengths in the gzip header: bytes of the member, and of the record

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length bigint, payload_length bigint, payload binary"
NAMES = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "content_length", "payload_length", "payload")
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Hadoop's names of stores that Arrow calls otherwise.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://"}


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; file, s3 (s3a, s3n), gs, hdfs and abfs are known."""
    for name, other in _SCHEMES.items():
        if uri.startswith(name):
            uri = other + uri.removeprefix(name)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ------------------------------------------------------------------- records


def _clean(value: str) -> str:
    """A header value stays on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_type: str, record_id: str, target_uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(target_uri)}"] if target_uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if record_type == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = SUBFIELD + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Input:
    """A buffered file with cheap skips."""

    def __init__(self, file: pa.NativeFile, block: int = 1 << 18):
        self.file, self.block, self.buf, self.at, self.base = file, block, b"", 0, 0

    def peek(self, n: int) -> bytes:
        """Up to n bytes, fewer only at the end."""
        while len(self.buf) - self.at < n:
            more = self.file.read(max(self.block, n - (len(self.buf) - self.at)))
            if not more:
                break
            self.base += self.at
            self.buf, self.at = self.buf[self.at :] + more, 0
        return self.buf[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        if self.at + n <= len(self.buf):
            self.at += n
        else:  # what is skipped is not read
            to = self.base + self.at + n
            self.file.seek(to)
            self.buf, self.at, self.base = b"", 0, to


class Plain:
    """The bytes of uncompressed records."""

    def __init__(self, source: Input):
        self.source = source

    def line(self) -> bytes:
        n = 256
        while True:
            got = self.source.peek(n)
            end = got.find(b"\n")
            if end >= 0 or len(got) < n:
                return self.source.take(end + 1 if end >= 0 else len(got))
            n *= 2

    def take(self, n: int) -> bytes:
        return self.source.take(n)

    def skip(self, n: int) -> None:
        self.source.skip(n)

    def leave(self) -> None:
        while self.source.peek(2)[:2] == b"\r\n":
            self.source.take(2)


class Member:
    """The bytes of one gzip member, inflated no further than they are asked for."""

    def __init__(self, source: Input):
        self.source, self.inflate, self.out = source, zlib.decompressobj(31), b""
        head = source.peek(24)
        self.end = None
        if head[3:4] == b"\x04" and head[12:14] == SUBFIELD:
            self.end = source.base + source.at + struct.unpack("<I", head[16:20])[0]

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        got = self.inflate.unconsumed_tail or self.source.take(1 << 13)
        if not got:
            return False
        self.out += self.inflate.decompress(got, 1 << 16)
        if self.inflate.eof and self.inflate.unused_data:
            self.source.at -= len(self.inflate.unused_data)
        return True

    def line(self) -> bytes:
        while (end := self.out.find(b"\n")) < 0 and self._more():
            pass
        end = len(self.out) if end < 0 else end + 1
        line, self.out = self.out[:end], self.out[end:]
        return line

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            self.out = b""
            if not self._more():
                break
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        pass  # leave() passes over the rest

    def leave(self) -> None:
        if self.end is not None:
            self.source.skip(self.end - self.source.base - self.source.at)
            return
        while self._more():
            self.out = b""


def read_records(source: Input, wanted, want_payload: bool) -> Iterator[tuple]:
    """Rows in the order of NAMES; a record whose headers are not wanted is passed over undecoded."""
    while head := source.peek(2):
        part = Member(source) if head == b"\x1f\x8b" else Plain(source)
        line = part.line()
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {source.base + source.at}: {line[:40]!r}")
        headers = {}
        while (line := part.line().strip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        length = int(headers.get("content-length", 0))
        row = {k: headers.get(v.lower()) for k, v in HEADERS.items()}
        for k in ("record_id", "refers_to"):
            row[k] = row[k].strip("<>") if row[k] else None
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if not wanted(row):
            part.skip(length)
            part.leave()
            continue
        payload_length, payload, left = None, None, length
        if headers.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = part.line()
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    payload_length = int(line.partition(b":")[2])
                if line in (b"\r\n", b"\n", b""):
                    break
        if want_payload and row["record_type"] != "revisit":
            payload = part.take(left)
        else:
            part.skip(left)
        part.leave()
        yield *(row[k] for k in NAMES[:5]), length, left if payload_length is None else payload_length, payload


# --------------------------------------------------------------- data source


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    """Plans one partition for each file; takes predicates on record type and headers."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = open_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [FilePart(root)]
        found = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File]
        manifest = [x.path for x in found if x.base_name == "_MANIFEST"]
        if manifest:  # files of tasks that failed or ran twice are not in it
            with fs.open_input_stream(manifest[0]) as f:
                return [FilePart(f"{root}/{name}") for name in f.read().decode().split()]
        return [FilePart(x.path) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith((".warc", ".warc.gz"))]

    def _wanted(self, row: dict) -> bool:
        for name, how, value in self.tests:
            have = row[name]
            if have is None or not (have in value if how == "in" else have.startswith(value)):
                return False
        return True

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of an archive without files
            return
        types = dict(zip(NAMES, [pa.string()] * 5 + [pa.int64()] * 2 + [pa.binary()], strict=True))
        at = [NAMES.index(n) for n in self.names]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[NAMES[i]]) for i in at], names=self.names)

        fs, _ = open_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            rows, size = [], 0
            for row in read_records(Input(file), self._wanted, self.payload and "payload" in self.names):
                rows.append(row)
                size += 200 + len(row[-1] or b"")
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class WarcWriter(DataSourceArrowWriter):
    """Writes record_type, record_id, target_uri, refers_to, payload_digest and payload as records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", FILE_BYTES))
        if overwrite:
            fs, root = open_uri(self.path)
            fs.create_dir(root, recursive=True)
            fs.delete_dir_contents(root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                columns = batch.slice(i, 256).to_pydict()
                for kind, rid, uri, ref, digest, payload in zip(*(columns[k] for k in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload")), strict=True):
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    payload = payload or b""
                    record = encode_record(kind, rid, uri, payload, digest or sha1_base32(payload), ref)
                    out.write(record)
                    size += len(record)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_uri(self.path)
        fs.create_dir(root, recursive=True)
        names = [name for m in messages if m for name in m.files]
        old = f"{root}/_MANIFEST"
        if fs.get_file_info(old).type == pafs.FileType.File:
            with fs.open_input_stream(old) as f:
                names = f.read().decode().split() + names
        with fs.open_output_stream(old) as f:
            f.write("\n".join(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_uri(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(uri)``, and the same to write."""

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
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ------------------------------------------------------------------ archives


def page_id_of(urn: F.Column) -> F.Column:
    return F.substring_index(urn, ":", -1).try_cast("long")


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record for each row; payloads equal to an earlier page's become revisits.

    Of equal payloads of ``least_bytes`` or more, the row with the smallest page id is
    the response (rows that share that id are all responses; null ids come last);
    others refer to it.  Null html is an empty payload; a null URL leaves out the
    target URI; other columns don't matter.  A very long payload is one record, held
    whole by its task.  Without rows the archive has no files and reads as empty.  Only
    digests are grouped, with partial sums; digests that stand once take no part in the
    join.
    """
    work = Workspace(spark, "warc")
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    read = read.withColumn("digest", F.sha1("html"))
    first = read.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    first = work.keep(first, "first")  # its size on disk decides how it is joined
    rows = read.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ((F.col("page_id") > F.col("first_id")) | F.col("page_id").isNull())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    records = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn("first_id")).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.col("html").cast("binary").alias("payload"),
    )
    register(spark)
    records.write.format("warc").mode("append").save(path)
