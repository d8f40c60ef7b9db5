"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Format "warc", options path, target_bytes (compressed bytes of a read partition). Each write task
makes one archive of gzip members, a record each, and an index of their offsets and types; the
driver's commit moves both to their names, so a lost or repeated task leaves nothing that is read.

Reading plans byte ranges of the archives, whose members a task finds in the index (an archive
without one is a partition of its own), takes equality, IN and prefix predicates on record type and header columns, decompresses a
record's headers first, and goes on to its payload only if the record passes and the schema has
the column `payload`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Column, header and type of what a read returns; `payload` is the body alone, without HTTP headers.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to_record": "WARC-Refers-To",
    "page_id": "X-Page-ID",
    "refers_to": "X-Refers-To-Page-ID",
    "payload_bytes": "X-Payload-Length",
}
NUMBERS = {"page_id", "refers_to", "payload_bytes"}
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary"
INPUT = "page_id long, url string, payload binary, digest string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit has the HTTP headers but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", date)]
    head.append(("WARC-Target-URI", urllib.parse.quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head.append(("X-Payload-Length", str(len(payload))))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


@dataclass
class ArchiveSpan(InputPartition):
    """The members of an archive that begin in bytes [start, stop); without an index, the whole archive."""

    path: str
    index: str | None
    start: int = 0
    stop: int = 0


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.overwrite = overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"  # of this write alone

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, folder = open_fs(self.path)
        name = uuid.uuid4().hex
        fs.create_dir(f"{folder}/{self.pending}", recursive=True)
        index, at = [], 0
        with fs.open_output_stream(f"{folder}/{self.pending}/{name}.warc.gz", compression=None) as out:
            for batch in iterator:
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    member = z.compress(make_record(page_id, url, payload or b"", digest or digest_of(payload or b""), refers_to, self.date)) + z.flush()
                    out.write(member)
                    index.append((at, len(member), "response" if refers_to is None else "revisit"))
                    at += len(member)
        with fs.open_output_stream(f"{folder}/{self.pending}/{name}.idx") as out:
            out.write(json.dumps(index).encode())
        return Archives([name])

    def commit(self, messages: list) -> None:
        fs, folder = open_fs(self.path)
        if self.overwrite:  # what was there goes only now that all of the new is written
            for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if f.is_file:
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.names if m else []:
                for end in (".idx", ".warc.gz"):
                    fs.move(f"{folder}/{self.pending}/{name}{end}", f"{folder}/{name}{end}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = open_fs(self.path)
        if fs.get_file_info(f"{folder}/{self.pending}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{folder}/{self.pending}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"].rstrip("/")
        self.target = int(options.get("target_bytes", 16 << 20))
        self.columns = columns
        self.equal: dict[str, set] = {}
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.equal[column] = self.equal.get(column, {f.value}) & {f.value}
            elif column in HEADERS and isinstance(f, In):
                self.equal[column] = self.equal.get(column, set(f.value)) & set(f.value)
            elif column in HEADERS and column not in NUMBERS and isinstance(f, StringStartsWith):
                self.prefix.append((column, f.value))
            else:
                yield f

    def partitions(self) -> list[ArchiveSpan]:
        """Byte ranges of the archives, from the folder's listing alone; the tasks read the indexes."""
        fs, folder = open_fs(self.path)
        files = {f.path: f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file}
        out = []
        for path in sorted(files):
            if not path.endswith((".warc.gz", ".warc")):
                continue
            at = path.removesuffix(".warc.gz") + ".idx"
            if at not in files:
                out.append(ArchiveSpan(path, None))
                continue
            out += [ArchiveSpan(path, at, a, a + self.target) for a in range(0, files[path].size, self.target)]
        return out

    def members(self, fs: pafs.FileSystem, span: ArchiveSpan) -> list[tuple[int, int]]:
        """Offset and length of the span's members, of the wanted types if those are known."""
        types = self.equal.get("record_type")
        with fs.open_input_stream(span.index) as f:
            return [(a, n) for a, n, kind in json.loads(f.read()) if span.start <= a < span.stop and (types is None or kind in types)]

    def passes(self, head: dict[str, str]) -> bool:
        return all(_value(c, head) in want for c, want in self.equal.items()) and all((_value(c, head) or "").startswith(p) for c, p in self.prefix)

    def read(self, partition: ArchiveSpan | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was none to plan
            return
        types = [pa.binary() if c == "payload" else pa.int64() if c in NUMBERS else pa.string() for c in self.columns]
        wanted = "payload" in self.columns
        rows, size = [], 0
        fs = open_fs(self.path)[0]
        for head, body in _records(fs, partition.path, self.members(fs, partition) if partition.index else None, self.passes, wanted):
            payload = None
            if wanted and head.get("warc-type") != "revisit" and body is not None:
                payload = body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body
            rows.append(tuple(payload if c == "payload" else _value(c, head) for c in self.columns))
            size += len(payload or b"") + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=self.columns)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=self.columns)


def _value(column: str, head: dict[str, str]):
    x = head.get(HEADERS[column].lower())
    return int(x) if x is not None and column in NUMBERS else x


def _records(fs: pafs.FileSystem, path: str, members: list[tuple[int, int]] | None, passes, wanted: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and the block if wanted, of the records that pass."""
    if members is None:
        yield from _stream(fs.open_input_stream(path, compression=None), path.endswith(".gz"), passes, wanted)
        return
    with fs.open_input_file(path) as f:
        for at, n in members:
            raw = f.read_at(n, at)
            z = zlib.decompressobj(31)
            data = z.decompress(raw, 2048)
            while b"\r\n\r\n" not in data and z.unconsumed_tail:
                data += z.decompress(z.unconsumed_tail, 2048)
            top, _, rest = data.partition(b"\r\n\r\n")
            head = parse_headers(top)
            if not passes(head):
                continue
            if not wanted or head.get("warc-type") == "revisit":
                yield head, None
                continue
            block = rest + z.decompress(z.unconsumed_tail) + z.flush()
            yield head, block[: int(head["content-length"])]


def _stream(f, gz: bool, passes, wanted: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an archive without an index, in order; unwanted blocks are read past without being kept."""
    z = zlib.decompressobj(31) if gz else None
    held = b""

    def more() -> bool:
        nonlocal held, z
        raw = f.read(1 << 16)
        if not raw:
            return False
        if z is None:
            held += raw
            return True
        while raw:
            held += z.decompress(raw)
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
        return True

    while True:
        held = held.lstrip(b"\r\n")
        while b"\r\n\r\n" not in held:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
            held = held.lstrip(b"\r\n")
        top, _, held = held.partition(b"\r\n\r\n")
        head = parse_headers(top)
        left = int(head["content-length"])
        keep = passes(head) and wanted
        parts = []
        while left:
            if not held and not more():
                raise ValueError("the archive ends within a record")
            if keep:
                parts.append(held[:left])
            taken = min(left, len(held))
            held, left = held[taken:], left - taken
        if passes(head):
            yield head, b"".join(parts) if keep else None


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        unknown = [c for c in schema.names if c != "payload" and c not in HEADERS]
        if unknown:
            raise ValueError(f"no such WARC columns: {unknown}")
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, *, min_bytes: int = 0) -> None:
    """Archives pages (page_id, url, html) under path; other columns are ignored.

    Of the rows with equal payloads of at least min_bytes, those with the smallest page_id are responses, the others
    revisits of it (rows that repeat that page_id too are responses; a null page_id counts as larger than any, and
    where no row of a payload has one, all are responses). A null html is an empty payload, a null url about:blank.
    Payloads are written whole, however long; a record must fit in a task's memory. No pages make no archive.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # A hot payload is combined before the shuffle, and its rows then split between tasks by the skew join.
    first = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    first = first.withColumnRenamed("sha", "key")
    joined = rows.join(first, rows["sha"] == first["key"], "left")
    refers = F.when(F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first"))), F.col("first"))
    joined.select("page_id", "url", "payload", F.lit(None).cast("string").alias("digest"), refers.alias("refers_to")).write.format("warc").option("path", path).mode("append").save()


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records under path; without the column payload no payload is decoded."""
    register(spark)
    names = columns or [*HEADERS, "payload"]
    schema = ", ".join(f"{c} {'binary' if c == 'payload' else 'long' if c in NUMBERS else 'string'}" for c in names)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def round_trip(pages: DataFrame, path: str, *, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Responses are measured on the payload that was read; a revisit has none, and its headers state both.
    """
    spark = pages.sparkSession
    write_pages(pages, path, min_bytes=min_bytes)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x or b"") for x in payloads], pa.int64()), pa.array([digest_of(x or b"") for x in payloads])], names=["page_id", "payload_bytes", "payload_digest"])

    responses = read_archives(spark, path, ["page_id", "record_type", "payload"]).where("record_type = 'response'").select("page_id", "payload").mapInArrow(measured, "page_id long, payload_bytes long, payload_digest string")
    revisits = read_archives(spark, path, ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]).where("record_type = 'revisit'")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", "refers_to")
    )
