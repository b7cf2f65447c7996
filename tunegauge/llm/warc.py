"""WARC archives as a Spark data source in Python: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

A read plans one partition per run of records of about ``partition_bytes``: whole files, packed, or the stretches that the
writer's manifest lists. Filters on headers go to the reader, which parses a record's headers first and steps over the block
of a record that no filter wants. Payloads are decoded only if the schema asks for the column ``payload``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tunegauge.llm.tables import slices, stored
from tunegauge.session import shared_folder

#: Columns of the source and the header each one comes from.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length",
}
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_length long, payload_length long, file string, offset bigint, payload binary"
)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18

TESTS = {
    EqualTo: lambda x, y: x is not None and x == y, EqualNullSafe: lambda x, y: x == y,
    GreaterThan: lambda x, y: x is not None and x > y, GreaterThanOrEqual: lambda x, y: x is not None and x >= y,
    LessThan: lambda x, y: x is not None and x < y, LessThanOrEqual: lambda x, y: x is not None and x <= y,
    In: lambda x, y: x is not None and x in y, IsNull: lambda x, _: x is None, IsNotNull: lambda x, _: x is not None,
    StringStartsWith: lambda x, y: x is not None and x.startswith(y), StringEndsWith: lambda x, y: x is not None and x.endswith(y),
    StringContains: lambda x, y: x is not None and y in x,
}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _line(name: str, value: str | None) -> bytes:
    """A header line; control characters, which would end the line, are percent-encoded."""
    if value is None:
        return b""
    clean = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)
    return f"{name}: {clean}\r\n".encode("utf-8", "surrogatepass")


def record(payload: bytes, record_id: str | None, target_uri: str | None, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has the response's headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", record_id and f"<{record_id}>") + _line("WARC-Date", date) + _line("WARC-Target-URI", target_uri)
    head += _line("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += _line("WARC-Refers-To", f"<{refers_to}>") + _line("WARC-Profile", REVISIT)
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return head + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    bytes: int
    starts: list[int]


@dataclass
class Stretch(InputPartition):
    """Parts of files: (file, first byte, byte after the last or None for the end of the file)."""

    parts: list[tuple[str, int, int | None]]


class WarcWriter(DataSourceArrowWriter):
    """A file per task under a name of its own; what the job's manifest does not list was left by a lost task."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"].rstrip("/"), names
        self.gzip = options.get("compression", "none") == "gzip"
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.split = int(options.get("split_bytes", 16 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        at = {c: self.names.index(c) for c in self.names}
        pick = lambda b, c: b.column(at[c]).to_pylist() if c in at else [None] * b.num_rows
        done, starts = 0, []
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in slices(iterator):
                columns = [pick(batch, c) for c in ("payload", "record_id", "target_uri", "refers_to")]
                for payload, record_id, uri, refers in zip(*columns):
                    if not starts or done - starts[-1] >= self.split:
                        starts.append(done)
                    data = record(payload or b"", record_id, uri, refers, self.date)
                    if self.gzip:
                        packer = zlib.compressobj(wbits=31)
                        data = packer.compress(data) + packer.flush()
                    out.write(data)
                    done += len(data)
        return Written(name, done, starts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files = [{"file": m.file, "bytes": m.bytes, "starts": m.starts} for m in messages if m is not None and m.starts]
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.file}")


class _Scan:
    """Sequential reading of a file or of its gzip members, with a step over bytes that are not wanted."""

    def __init__(self, store: fs.FileSystem, path: str, start: int):
        self.raw = store.open_input_file(path)
        self.raw.seek(start)
        self.gzip = path.endswith(".gz")
        self.member, self.left, self.held = None, b"", b""
        self.offset, self.fed = start, start

    def _more(self) -> bool:
        if not self.gzip:
            data = self.raw.read(CHUNK)
            self.held += data
            return bool(data)
        while True:
            if not self.left:
                self.left = self.raw.read(CHUNK)
                self.fed += len(self.left)
            if not self.left:
                return False
            if self.member is None:
                self.member = zlib.decompressobj(wbits=31)
            data = self.member.decompress(self.left, CHUNK)
            self.left = self.member.unused_data or self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark, which are left to be read again; None if the file ends before."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        return self.held[: at + len(mark)]

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self._more():
                break
            parts.append(self.held)
            size += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        self.offset += min(n, len(data))
        return data[:n]

    def skip(self, n: int) -> None:
        while not self.gzip and n > len(self.held):
            self.raw.seek(self.offset + n)
            self.offset, self.held, n = self.offset + n, b"", 0
        while n > len(self.held):
            n, self.offset, self.held = n - len(self.held), self.offset + len(self.held), b""
            if not self._more():
                return
        self.held, self.offset = self.held[n:], self.offset + n

    def place(self) -> int:
        """Where the next record starts in the file; exact between members of a gzip file."""
        return self.fed - len(self.left) if self.gzip else self.offset


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, mark, value = line.partition(":")
        if mark:
            out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"].rstrip("/"), schema.names
        self.size = int(options.get("partition_bytes", 16 << 20))
        self.wanted: list[tuple[type, str, object, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            column = getattr(inner, "attribute", ("",))
            if type(inner) in TESTS and len(column) == 1 and column[0] in HEADERS and not negated:
                self.wanted.append((type(inner), column[0], getattr(inner, "value", None), negated))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        """Stretches of about ``partition_bytes``; files that only a lost task wrote are left out."""
        store, root = _opened(self.path)
        info = {x.base_name: x for x in store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)) if x.is_file}
        parts: list[tuple[str, int, int | None, int]] = []
        manifests = [x for name, x in sorted(info.items()) if name.startswith("_manifest-")]
        for x in manifests:
            with store.open_input_stream(x.path, compression=None) as f:
                for entry in json.loads(f.read()):
                    ends = [*entry["starts"][1:], entry["bytes"]]
                    parts += [(entry["file"], a, b, b - a) for a, b in zip(entry["starts"], ends)]
        if not manifests:
            parts = [(n, 0, None, x.size) for n, x in sorted(info.items()) if n.endswith((".warc", ".warc.gz"))]
        out, held = [], self.size
        for name, a, b, n in parts:
            if held + n > self.size:
                out.append(Stretch([]))
                held = 0
            out[-1].parts.append((name, a, b))
            held += n
        return out or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.names])
        rows, held = [], 0
        for name, start, stop in partition.parts:
            for row in self._records(store, root, name, start, stop):
                rows.append(row)
                held += len(row.get("payload") or b"") + 200
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, store: fs.FileSystem, root: str, name: str, start: int, stop: int | None) -> Iterator[dict]:
        scan = _Scan(store, f"{root}/{name}", start)
        while stop is None or scan.held or scan.place() < stop:
            offset = scan.place()
            if not scan.gzip and stop is not None and offset >= stop:
                return
            if (head := scan.until(b"\r\n\r\n")) is None:
                return
            scan.take(len(head))
            found = _headers(head)
            row = {c: found.get(h) for c, h in HEADERS.items()}
            row["content_length"] = length = int(row["content_length"] or 0)
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            if not all(TESTS[kind](row[c], value) for kind, c, value, _ in self.wanted):
                scan.skip(length + 4)
                continue
            row |= {"file": name, "offset": offset, "payload_length": length, "payload": None}
            http = found.get("content-type", "").startswith("application/http")
            inner = scan.until(b"\r\n\r\n") if http and length else b""
            if inner and len(inner) <= length:
                scan.take(len(inner))
                length -= len(inner)
                told = _headers(inner).get("content-length", "")
                row["payload_length"] = int(told) if told.isdigit() else length
            if "payload" in self.names and row["record_type"] != "revisit":
                row["payload"] = scan.take(length)
                length = 0
            scan.skip(length + 4)
            yield {c: row.get(c) for c in self.names}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; write to a new folder")
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session and let Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record per page; of equal payloads of ``least`` bytes or more, all but that of the largest id are revisits.

    Null payloads are empty. Rows that repeat the largest id are responses too; a null id is smaller than any other and refers
    to the largest, and pages whose ids are all null are responses. A null url gives no target header.
    """
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).cast("string").alias("target_uri"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1 and last is not null").select("sha", "last"), "payload-groups")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    register(pages.sparkSession)
    rows.join(groups, "sha", "left").select(
        "payload", "target_uri", name(F.col("id")).alias("record_id"),
        F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), name(F.col("last"))).alias("refers_to"),
    ).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of a folder of archives. ``columns`` (a schema string) decides what is decoded; leave out payload to skip it."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: ids, lengths, digests, types, payloads."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_pages(pages, path, least=least)
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
    return read_archive(spark, path).select(
        number("record_id").alias("page_id"), "target_uri", "payload_length", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "payload",
    )
