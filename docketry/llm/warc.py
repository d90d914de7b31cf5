"""WARC archives as a Spark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading. The files of a path are packed into partitions of about ``split_bytes``; a file is read in turn by one task, a record at a time. Of each
record the header comes first: predicates on the record's type and other header fields (the columns of HEADERS) are pushed down
and judged there, and what they drop is skipped, as are payloads that the schema doesn't name: in plain files by seeking, in gzip members that
carry their length (the extra field SL that our writer and some crawlers set) by seeking too, without inflating, otherwise by inflating and
discarding. A chunked HTTP body is put together; a content coding is left as it is.

Writing. Rows become records, each a gzip member of its own, in files of about ``file_bytes``, written aside under a name of the task's own and
moved into the folder when all tasks are done; what lost or repeated tasks left goes with the folder aside. ``archive`` says
which records are revisits: of equal payloads of ``least`` bytes or more the largest key is the response, others carry the headers only and name it
in WARC-Refers-To. Equal are payloads of equal SHA-256 and length. Who is a copy is found from digests; payloads aren't shuffled unless so
many copies were found that Spark won't broadcast the list of their digests, then rows of a hot digest are split by AQE.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS), on whose paths executors and driver must agree.

Null payloads are empty; null keys give records without a key, which are revisits of a keyed one. Rows that repeat key and payload of a
response are responses too. A URL's white space and control characters are written as %XX. A record that can't be read
is a row with its place and ``error``, and ends its file, as what follows has no known place; a file cut short gives one such row. An
empty table gives no files or files of no records, and an empty folder no rows. Columns of the input that aren't asked for are dropped before
writing, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
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
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from docketry.llm.frames import shared_folder, utf8, written

#: Columns that are header fields, on which predicates are pushed down. payload_sha1 is a SHA-1 payload_digest as hex.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "content_length": "content-length", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, date string, content_type string, content_length long, refers_to string, payload_digest string, payload_sha1 string, "
    "headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, error string"
)
#: What the writer takes; others than record_id may be missing or null. payload_bytes and payload_sha1 (hex) are of the payload that a revisit doesn't hold.
WRITTEN = ("record_type", "record_id", "target_uri", "date", "payload", "payload_bytes", "payload_sha1", "refers_to")
#: A header larger than this is a fault.
HEADER_BYTES = 1 << 20
#: Bytes and rows of a batch that is handed on.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
#: Bytes that are read at once; of gzip members, that are inflated at once.
_READ, _PACKED = 1 << 18, 1 << 13


# Reading


class _Plain:
    """The bytes of a file from a place on."""

    def __init__(self, file):
        self.file = io.BufferedReader(file, _READ)
        self.size, self.start = file.size(), 0

    def begin(self) -> int | None:
        """The place of the next record; None at the end."""
        self.start = self.file.tell()
        return self.start if self.start < self.size else None

    def line(self) -> bytes:
        return self.file.readline(HEADER_BYTES)

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> int:
        at = min(n, max(0, self.size - self.file.tell()))
        self.file.seek(at, 1)
        return at

    def end(self) -> None:
        if self.read(4) != b"\r\n\r\n":
            raise ValueError("no end of record")


class _Gzip:
    """The inflated bytes of a file of gzip members."""

    def __init__(self, file):
        self.file = io.BufferedReader(file, _READ)
        self.size = file.size()
        self.held, self.inflate, self.last = b"", None, None
        self.start = self.used = self.holds = 0

    def begin(self) -> int | None:
        while not self.held:
            if self.inflate is None:
                if self.file.tell() >= self.size:
                    return None
                self._member()
            elif not self._more():
                self.inflate = None
        return self.start

    def _member(self) -> None:
        self.start = self.file.tell()
        head = self.file.read(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        self.last, self.used, flags = None, 0, head[3]
        if flags & 4:
            extra = self.file.read(*struct.unpack("<H", self.file.read(2)))
            while len(extra) >= 4:
                (size,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"SL" and size == 8:
                    packed, self.holds = struct.unpack("<II", extra[4:12])
                    self.last = self.start + packed
                extra = extra[4 + size :]
        for flag in (8, 16):  # name, comment
            while flags & flag and self.file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            self.file.read(2)
        self.inflate = zlib.decompressobj(-15)

    def _more(self) -> bool:
        """Holds more inflated bytes; False at the member's end."""
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.file.read1(_PACKED)
        if not raw:
            raise ValueError("the file ends within a record")
        self.held += self.inflate.decompress(raw, _READ)
        if self.inflate.eof:
            self.file.seek(8 - len(self.inflate.unused_data), 1)  # its checksum and length
        return True

    def line(self) -> bytes:
        while b"\n" not in self.held and len(self.held) < HEADER_BYTES and self._more():
            pass
        return self.read(self.held.find(b"\n") + 1 or len(self.held))

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.held and not self._more():
                break
            some, self.held = self.held[:n], self.held[n:]
            parts.append(some)
            n, self.used = n - len(some), self.used + len(some)
        return b"".join(parts)

    def skip(self, n: int) -> int:
        done = 0
        while done < n and (some := len(self.read(min(n - done, _READ)))):
            done += some
        return done

    def end(self) -> None:
        if self.read(4) != b"\r\n\r\n":
            raise ValueError("no end of record")

    def leap(self, left: int) -> bool:
        """To the member's end, if its length is known and it ends with the record of which so many bytes are left."""
        if self.last is None or self.used + left + 4 != self.holds:
            return False
        self.file.seek(self.last)
        self.held, self.inflate = b"", None
        return True


def _fields(stream, first: bytes) -> dict[str, str]:
    """Header fields to the empty line, by lower-case names; a line that begins with white space goes on."""
    out, name, size = {}, None, len(first)
    while (raw := stream.line()) not in (b"\r\n", b"\n"):
        size += len(raw)
        if not raw.endswith(b"\n") or size > HEADER_BYTES:
            raise ValueError("a header without an end")
        text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        else:
            name, found, value = text.partition(":")
            if not found:
                raise ValueError("a header line without a colon")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _holds(filters: list[Filter], values: dict) -> bool:
    """Whether all pushed predicates are true of a header's columns."""

    def judge(f: Filter) -> bool | None:
        if isinstance(f, Not):
            inner = judge(f.child)
            return None if inner is None else not inner
        at = values.get(f.attribute[0])
        if isinstance(f, IsNull):
            return at is None
        if isinstance(f, IsNotNull):
            return at is not None
        if isinstance(f, EqualNullSafe):
            return at == f.value
        if at is None or isinstance(f, EqualTo) and f.value is None:
            return None
        if isinstance(f, In):
            return at in f.value or (None if None in f.value else False)
        return _JUDGED[type(f)](at, f.value)

    return all(judge(f) for f in filters)


_JUDGED = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
}


def _judged(f: Filter) -> bool:
    """Whether the header decides a predicate. Text is compared as code points, as Spark does."""
    if isinstance(f, Not):
        return _judged(f.child)
    return (type(f) in _JUDGED or isinstance(f, (In, IsNull, IsNotNull, EqualNullSafe))) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


class _Part:
    """What is left of a block, as a stream of lines and bytes."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def line(self) -> bytes:
        if not self.left:
            return b""
        raw = self.stream.line()
        if len(raw) > self.left:
            raise ValueError("a header runs past its block")
        self.left -= len(raw)
        return raw

    def read(self) -> bytes:
        raw = self.stream.read(self.left)
        if len(raw) < self.left:
            raise ValueError("the file ends within a record")
        self.left = 0
        return raw

    def skip(self) -> None:
        if self.left and self.stream.skip(self.left) < self.left:
            raise ValueError("the file ends within a record")
        self.left = 0


def _sha1(digest: str | None) -> str | None:
    """The bare lower-case hex of a digest that is labelled sha1, in base32 or hex."""
    label, _, said = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", said):
        return said.lower()
    return base64.b32decode(said.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", said) else None


def dechunked(body: bytes) -> bytes:
    """A chunked HTTP body put together; as it is if it isn't one."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return body
        at = end + 4 + n


def records(file, name: str, wanted: set[str], filters: list[Filter] = ()) -> Iterator[dict]:
    """Rows of one file with the wanted columns of SCHEMA."""
    stream = (_Gzip if name.endswith(".gz") else _Plain)(file)
    try:
        while (at := stream.begin()) is not None:
            version = stream.line()
            if version in (b"\r\n", b"\n"):  # more empty lines than asked for
                continue
            if not re.fullmatch(rb"WARC/\d+\.\d+\r?\n", version):
                raise ValueError("no WARC record")
            fields = _fields(stream, version)
            row = {column: fields.get(field) for column, field in HEADERS.items()}
            if not (row["content_length"] or "").isdecimal():
                raise ValueError("no Content-Length")
            row["content_length"] = int(row["content_length"])
            row["record_id"], row["refers_to"] = ((x or "").strip("<> ") or None for x in (row["record_id"], row["refers_to"]))
            row["payload_sha1"] = _sha1(row["payload_digest"])
            part = _Part(stream, row["content_length"])
            taken = _holds(filters, row)
            if taken:
                row |= {"file": name, "offset": at, "headers": fields}
                http = None
                if re.match(r"application/http\b", row["content_type"] or "") and wanted & {"http_status", "http_headers", "payload"}:
                    first = part.line()
                    http = _fields(part, first)
                    status = re.match(rb"HTTP/\S+ (\d{3})\b", first)
                    row |= {"http_status": int(status[1]) if status else None, "http_headers": http}
                if "payload" in wanted:
                    body = part.read()
                    row["payload"] = dechunked(body) if http and "chunked" in http.get("transfer-encoding", "").lower() else body
            if not (isinstance(stream, _Gzip) and part.left and stream.leap(part.left)):
                part.skip()
                stream.end()
            if taken:
                yield row
    except (ValueError, zlib.error, OSError, struct.error) as e:
        row = dict.fromkeys(HEADERS)
        if _holds(filters, row):
            yield row | {"file": name, "offset": stream.start, "error": str(e) or type(e).__name__}


def _place(path: str):
    """Arrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^(\w{2,}):/+", r"\1:///", path))


@dataclass
class Files(InputPartition):
    """Files that one task reads in turn."""

    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _judged(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _place(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        below = len(path.rstrip("/")) + 1
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and not re.search(r"(^|/)[._]", x.path[below:]))
        out, held = [], 0
        for name, size in files:
            if not out or held + size > self.split_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, wanted = to_arrow_schema(self.schema), set(self.schema.names)
        system, _ = _place(self.path)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [[r.get(f.name) for r in held] for f in arrow]
            columns = [[list(m.items()) if m is not None else None for m in c] if pa.types.is_map(f.type) else c for c, f in zip(columns, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for name in partition.names if partition else ():
            with system.open_input_file(name) as file:
                for row in records(file, name, wanted, self.filters):
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


# Writing


def _member(raw: bytes, level: int) -> bytes:
    """A gzip member that carries its own length and that of its content in the extra field SL."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    known = struct.pack("<2sHII", b"SL", 8, whole, len(raw)) if max(whole, len(raw)) < 1 << 32 else b"XX\x08\0" + bytes(8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + known + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _said(value: str) -> str:
    """A header's value without what would end it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A response or revisit record of a row of WRITTEN."""
    payload, revisit = row.get("payload") or b"", row.get("record_type") == "revisit"
    if revisit:
        size, digest, payload = row["payload_bytes"], bytes.fromhex(row["payload_sha1"]), b""
    else:
        size, digest = len(payload), hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_said(row['record_id'])}>", f"WARC-Date: {_said(row.get('date') or '1970-01-01T00:00:00Z')}"]
    if row.get("target_uri"):
        head.append(f"WARC-Target-URI: {_said(row['target_uri'])}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_said(row['refers_to'])}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: docketry\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Done(WriterCommitMessage):
    """Files that a task has written aside."""

    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        if "record_id" not in schema.names or set(schema.names) - {*WRITTEN}:
            raise ValueError(f"columns must be record_id and some of {', '.join(WRITTEN)}")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.file_bytes, self.level = int(options.get("file_bytes", 1 << 30)), int(options.get("level", 1))

    def _aside(self, root: str) -> str:
        return f"{root.rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        system, root = _place(self.path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for lo in range(0, batch.num_rows, 64):
                    for row in batch.slice(lo, 64).to_pylist():
                        if out is None:
                            names.append(f"{self._aside(root)}/part-{uuid.uuid4().hex}.warc.gz")
                            system.create_dir(self._aside(root), recursive=True)
                            out, size = system.open_output_stream(names[-1], compression=None, buffer_size=1 << 20), 0
                            size += out.write(_member(_info(names[-1].rpartition("/")[2]), self.level))
                        size += out.write(_member(record(row), self.level))
                        if size >= self.file_bytes:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        return Done(names)

    def commit(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(name, f"{root.rstrip('/')}/{name.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        system, root = _place(self.path)
        if system.get_file_info(self._aside(root)).type == fs.FileType.Directory:
            system.delete_dir(self._aside(root))
            above = f"{root.rstrip('/')}/_temporary"
            if not system.get_file_info(fs.FileSelector(above)):
                system.delete_dir(above)


class WarcSource(DataSource):
    """Options: path; split_bytes of a partition (64 MB); for writing file_bytes of a file (1 GB) and the deflate level (1)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets predicates be pushed into it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of the archives below a path; of all columns of SCHEMA, or of those named, in this order."""
    register(spark)
    known = {f.name: f for f in T._parse_datatype_string(SCHEMA).fields}
    return spark.read.format("warc").schema(T.StructType([known[c] for c in columns or known])).option("split_bytes", split_bytes).load(path)


def roles(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 1000) -> DataFrame:
    """The digest of each payload of ``least`` bytes or more that several rows hold: digest (SHA-256), size, head (the largest key)."""
    held = pages.select(F.col(f"`{key}`").alias("head"), utf8(F.col(f"`{payload}`")).alias("held")).select("head", F.sha2("held", 256).alias("digest"), F.octet_length("held").alias("size"))
    return held.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("head").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL").drop("n")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("")))


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, file_bytes: int = 1 << 30) -> None:
    """Writes the pages to archives below path, equal payloads once."""
    register(pages.sparkSession)
    shared = written(roles(pages, key, payload, least), "payloads")
    raw = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("target_uri"), utf8(F.col(f"`{payload}`")).alias("payload"))
    raw = raw.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")}).join(shared, ["digest", "size"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head"))
    made = raw.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_id(F.col("key")).alias("record_id"), "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"), F.col("size").cast("long").alias("payload_bytes"), F.when(revisit, F.sha1("payload")).alias("payload_sha1"), F.when(revisit, record_id(F.col("head"))).alias("refers_to"),
    )
    made.write.format("warc").mode("append").option("file_bytes", file_bytes).save(path)


def folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/tables/archives-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def sql() -> str:
    """DuckDB SQL for op13."""
    return """
    WITH held AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         ranked AS (SELECT page_id, h, octet_length(encode(h)) AS size, max(page_id) OVER (PARTITION BY h) AS head FROM held),
         judged AS (SELECT *, size >= 1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head AS revisit FROM ranked)
    SELECT page_id, size AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN head END AS refers_to FROM judged"""
