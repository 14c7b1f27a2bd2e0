"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition per group of archives, checks
record types and headers first, and inflates a payload only for records that pass.
``df.write.format("warc")`` writes one gzip member per record with its lengths in
the member's header, so that a reader can jump over it.

A write is visible once its list of files is in place (``_committed``): files of
lost or repeated tasks are not on the list and are never read. Folders without a
list, such as foreign crawls, are read in full. Paths may be any that
``pyarrow.fs`` can open.

Null payloads and texts count as empty; a null id is written as an empty one and
read as null. An empty table makes a folder without archives, which reads as no
rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
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
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import splittable_join
from ..sources.storage import new_folder, stage

RECORD_DDL = (
    "record_id string, record_type string, target_uri string, record_date string, "
    "payload_digest string, refers_to string, payload_length long, "
    "headers map<string,string>, payload binary, file string, offset long"
)
# Headers behind the columns, as named in the WARC standard; the length is our own.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
COMMITTED = "_committed"
_BLOCK = 1 << 16
_BATCH_BYTES = 4 << 20


def open_files(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# ---- records -------------------------------------------------------------------


def _line(value) -> str:
    return " ".join(str(value).split("\n")).replace("\r", " ")


def make_record(row: dict) -> bytes:
    """One record, uncompressed. A revisit carries no payload."""
    revisit = row.get("record_type") == "revisit"
    payload = row.get("payload") or b""
    is_http = row.get("record_type") == "response"
    block = (HTTP_HEAD % len(payload)).encode() + payload if is_http else payload
    block = b"" if revisit else block
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if column in ("record_id", "refers_to") and (value is not None or column == "record_id"):
            head.append(f"{name}: <{_line(value if value is not None else '')}>")
        elif value is not None:
            head.append(f"{name}: {_line(value)}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head.append("Content-Type: " + ("application/http;msgtype=response" if is_http or revisit
                                    else "application/octet-stream"))
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 4) -> bytes:
    """A gzip member whose header tells both its lengths (extra field ``sl``)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 24 + len(body) + 8
    if size >= 1 << 32:
        size = 0  # too long to tell: the reader then inflates to the end
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields; continued lines are joined."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip()
            fields[last] = value.strip()
    return fields


def _value(fields: dict[str, str], column: str):
    value = fields.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">") or None
    if column == "payload_length":
        return int(value) if value.isdigit() else None
    return value


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The entity of an HTTP block, or the block itself."""
    if fields.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Source:
    """Forward reading of a file with cheap jumps."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data


class _Inflated:
    """The bytes of one gzip member, inflated only as far as they are asked for."""

    def __init__(self, source: _Source):
        self.source, self.start = source, source.at
        self.inflate = zlib.decompressobj(31)
        self.first = source.read(_BLOCK)
        self.jump = 0
        if len(self.first) >= 24 and self.first[3] & 4 and self.first[12:14] == b"sl":
            self.jump = struct.unpack("<I", self.first[16:20])[0]
        self.pending = self.first

    def read(self, n: int) -> bytes:
        found = []
        while n > 0 and not self.inflate.eof:
            if not self.pending:
                self.pending = self.source.read(_BLOCK)
                if not self.pending:
                    raise EOFError(f"archive ends inside the record at byte {self.start}")
            made = self.inflate.decompress(self.pending, n)
            self.pending = self.inflate.unconsumed_tail
            found.append(made)
            n -= len(made)
        return b"".join(found)

    def close(self) -> None:
        """Go to the next member: by its length if known, else by inflating."""
        if self.jump:
            self.source.at = self.start + self.jump
            return
        while not self.inflate.eof:
            self.read(_BLOCK)
        self.source.at -= len(self.inflate.unused_data)


class _Plain:
    """An uncompressed record."""

    def __init__(self, source: _Source):
        self.source, self.end = source, None

    def read(self, n: int) -> bytes:
        return self.source.read(n)

    def close(self) -> None:
        self.source.at = self.end


def read_records(file, wanted, with_payload: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    """``(offset, header fields, payload)`` of the records whose header is wanted."""
    source = _Source(file)
    while source.at < source.size:
        offset = source.at
        start = source.read(2)
        source.at = offset
        zipped = start == b"\x1f\x8b"
        record = _Inflated(source) if zipped else _Plain(source)
        head = b""
        while (end := head.find(b"\r\n\r\n")) < 0:
            more = record.read(1024)
            if not more:
                break
            head += more
        if end < 0:
            if head.strip():
                raise ValueError(f"no record header at byte {offset}")
            return
        lead = len(head) - len(head.lstrip(b"\r\n"))
        fields = parse_head(head[lead:end])
        length, rest = int(fields.get("Content-Length", 0)), head[end + 4 :]
        if not zipped:
            record.end = min(source.size, offset + end + 4 + length + 4)
        if wanted(fields):
            payload = None
            if with_payload:
                block = rest[:length] + record.read(max(0, length - len(rest)))
                if len(block) < length:
                    raise EOFError(f"archive ends inside the record at byte {offset}")
                payload = payload_of(fields, block)
            yield offset, fields, payload
        record.close()


# ---- data source ----------------------------------------------------------------


@dataclass
class Archives(InputPartition):
    paths: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.schema = schema
        self.tests: list[tuple[str, str, tuple]] = []
        if types := options.get("recordtypes"):
            self.tests.append(("record_type", "in", tuple(types.split(","))))
        if prefix := options.get("uriprefix"):
            self.tests.append(("target_uri", "prefix", (prefix,)))

    def partitions(self):
        """Archives in groups of about ``partitionBytes``; an archive is never cut.

        A folder that a write has finished counts with the archives this write lists,
        any other folder, subfolders included, with all its archives.
        """
        store, path = open_files(self.path)
        listed = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        found = {i.path: i.size for i in listed if i.is_file}
        folders: dict[str, list[str]] = {}
        for p in sorted(found):
            folders.setdefault(p.rpartition("/")[0], []).append(p)
        archives = []
        for folder, files in folders.items():
            marker = f"{folder}/{COMMITTED}"
            if marker not in found:
                archives += [p for p in files if p.endswith((".warc", ".warc.gz"))]
                continue
            with store.open_input_stream(marker) as f:
                listed = {f"{folder}/{name}" for name in json.loads(f.read())}
            gone = listed - found.keys()
            if gone:
                raise FileNotFoundError(f"{len(gone)} archives of {folder} are gone")
            archives += sorted(listed)
        groups, size = [Archives()], 0
        for p in archives:
            if groups[-1].paths and size + found[p] > self.target:
                groups.append(Archives())
                size = 0
            groups[-1].paths.append(p)
            size += found[p]
        return groups

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, kind, values in self.tests:
            value = _value(fields, column)
            if value is None:
                return False
            if kind == "in" and value not in values:
                return False
            if kind == "prefix" and not value.startswith(values):
                return False
        return True

    def read(self, partition: Archives):
        names = self.schema.names
        arrow = to_arrow_schema(self.schema)
        store, _ = open_files(self.path)
        rows: list[dict] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for path in partition.paths:
            with store.open_input_file(path) as file:
                for offset, fields, payload in read_records(
                    file, self._wanted, "payload" in names
                ):
                    row = {c: _value(fields, c) for c in HEADERS if c in names}
                    row |= {"payload": payload, "file": path, "offset": offset}
                    if "headers" in names:
                        row["headers"] = list(fields.items())
                    rows.append({n: row[n] for n in names})
                    size += 500 + len(payload or b"")
                    if size >= _BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class PushingWarcReader(WarcReader):
    """For sessions with ``spark.sql.python.filterPushdown.enabled``; Spark refuses it elsewhere."""

    def pushFilters(self, filters):
        """Take over equality, IN and prefix tests on single header columns."""
        kinds = {EqualTo: "in", In: "in", StringStartsWith: "prefix"}
        for f in filters:
            kind, name = kinds.get(type(f)), getattr(f, "attribute", ("",))
            if kind and len(name) == 1 and name[0] in HEADERS and name[0] != "payload_length":
                value = f.value
                values = tuple(value) if isinstance(value, (list, tuple)) else (value,)
                if all(isinstance(v, str) for v in values):
                    self.tests.append((name[0], kind, values))
                    continue
            yield f


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.roll = int(options.get("archivebytes", 256 << 20))
        self.overwrite = overwrite

    def write(self, batches) -> Written:
        store, path = open_files(self.path)
        store.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(
                        f"{path}/{names[-1]}", compression=None
                    ), 0
                member = gzip_member(make_record(row))
                out.write(member)
                size += len(member)
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        store, path = open_files(self.path)
        store.create_dir(path, recursive=True)
        names = [n for m in messages if m for n in m.names]
        marker = f"{path}/{COMMITTED}"
        if not self.overwrite and store.get_file_info(marker).is_file:
            with store.open_input_stream(marker) as f:
                names += json.loads(f.read())
        with store.open_output_stream(marker) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages) -> None:
        store, path = open_files(self.path)
        for name in [n for m in messages if m for n in m.names]:
            store.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``recordTypes``, ``uriPrefix``, ``partitionBytes``,
    ``pushFilters`` (needs ``spark.sql.python.filterPushdown.enabled``); writing: ``archiveBytes``. A schema without ``payload`` leaves payloads packed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_DDL

    def reader(self, schema) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        kind = PushingWarcReader if options.get("pushfilters") == "true" else WarcReader
        return kind(options, schema)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_warc(
    spark: SparkSession,
    path: str,
    *,
    columns: str = RECORD_DDL,
    record_types: tuple[str, ...] = (),
    uri_prefix: str | None = None,
) -> DataFrame:
    """Records of a folder of archives; leave ``payload`` out of ``columns`` to skip it."""
    spark.dataSource.register(WarcDataSource)
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("warc").schema(columns).option("pushFilters", pushing)
    if record_types:
        reader = reader.option("recordTypes", ",".join(record_types))
    if uri_prefix:
        reader = reader.option("uriPrefix", uri_prefix)
    return reader.load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows with the columns of ``RECORD_DDL`` that they have."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)


# ---- pages ----------------------------------------------------------------------

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four letters from every five hex digits."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def page_records(pages: DataFrame) -> DataFrame:
    """Records for ``(page_id, url, html)``: equal payloads are stored once.

    Of pages with equal payloads that with the largest id is the response and the
    others revisit it. Rows that repeat the response's id are responses as well;
    without any id all are. Only payloads seen twice are joined, so where they
    are few no page is shuffled.
    """
    typed = pages.select(
        "page_id",
        "url",
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = (
        typed.groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = splittable_join(typed, stage(repeated, "warc_repeated"), "digest", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        F.concat(F.lit("urn:page:"), F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("response_id"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives and return what the archives say of them.

    Length and digest of a response are taken from the payload as read back.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(page_records(pages), folder)
    records = read_warc(
        spark,
        folder,
        columns="record_id string, record_type string, payload_digest string, "
        "refers_to string, payload_length long, payload binary",
    )
    stored = F.col("record_type") == "response"

    def page(col: str) -> Column:
        return F.regexp_extract(col, "([0-9-]+)$", 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long"))
        .otherwise(F.col("payload_length"))
        .alias("payload_bytes"),
        F.when(stored, base32_sha1(F.col("payload")))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
        .alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
