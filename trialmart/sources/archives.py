"""Tar archives and large single files turned into splittable tables.

An archive is read in place, whatever its size. One task per archive lists the
members: it jumps from header to header in a plain archive and streams a gzip one. The
members' bytes are then read chunk by chunk by many tasks (``byte_access``; gzip
archives through their index), and a member longer than a chunk by several.
"""

from __future__ import annotations

import csv
import io
import sys
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import splittable_join
from ..functions.fixed_values import LINES_PER_TARGET_MB, MIN_LINES_PER_SHARD
from . import byte_access
from .byte_access import CHUNK_BYTES, StretchFile, StrictMember, listing, locate, open_chunk, spread
from .gzip_index import chunks, lines_of, read_lines
from .storage import stage

# The functions below travel with the job, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH = 20_000
_BOM = b"\xef\xbb\xbf"


def _is_wanted(member: tarfile.TarInfo, suffix: str) -> bool:
    name = member.name.rsplit("/", 1)[-1]
    companion = name.startswith("._") or name == ".DS_Store"
    return member.isfile() and not companion and name.endswith(suffix)


def _members_of(path: str) -> Iterator[tarfile.TarInfo]:
    """The members in order; of a gzip archive offsets count decompressed bytes."""
    store, name = locate(path)
    with store.open_input_file(name) as file:
        if path.endswith((".gz", ".tgz")):
            stream = StretchFile(byte_access.members(file), 0)
            stream.seek_to(0, sys.maxsize, open_end=True)
            tar = tarfile.open(fileobj=io.BufferedReader(stream), mode="r|", tarinfo=StrictMember)
        else:
            tar = tarfile.open(fileobj=file, mode="r:", tarinfo=StrictMember)
        while (member := tar.next()) is not None:
            yield member
            tar.members.clear()  # else they pile up


def _listed(files: DataFrame, ddl: str, rows_of: Callable[[str], Iterator[dict]]) -> DataFrame:
    """Rows found in each file by one task, ``archive`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append({"archive": path, **row})
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_pylist(rows)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return spread(files.select("path")).mapInArrow(run, f"archive string, {ddl}")


def tar_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(archive, member, offset, size)`` of the files in the archives, companions left out."""

    def rows_of(archive: str) -> Iterator[dict]:
        for m in _members_of(archive):
            if _is_wanted(m, suffix):
                yield {"member": m.name, "offset": m.offset_data, "size": m.size}

    return _listed(listing(spark, path), "member string, offset long, size long", rows_of)


def preview_tar_members(spark: SparkSession, path: str, limit: int = 5) -> DataFrame:
    """Names of the first members of each archive (SRC11); no more of it is read."""

    def rows_of(archive: str) -> Iterator[dict]:
        left = limit
        for m in _members_of(archive):
            if left and m.isfile():
                left -= 1
                yield {"member": m.name}
            if not left:
                return

    return _listed(listing(spark, path), "member string", rows_of)


def _pieces(
    spark: SparkSession, path: str, suffix: str, index_dir: str | None, chunk_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """What each chunk holds of each member, ``path, chunk, member, offset, stop, begin, upto``; the chunks."""
    members = stage(tar_members(spark, path, suffix), "tar_members")
    planned = stage(chunks(spark, path, index_dir=index_dir, chunk_bytes=chunk_bytes), "tar_chunks")
    last = F.col("offset") + F.greatest(F.col("size"), F.lit(1)) - 1
    ends = members.select(
        F.col("archive").alias("path"), F.explode(F.array("offset", last)).alias("at"),
        F.struct("member", "offset", (F.col("offset") + F.col("size")).alias("stop")).alias("m"),
    )
    starts = planned.select("path", F.col("start").alias("at"), "chunk")
    # Rows of one archive: its members and chunks, without their bytes.
    order = Window.partitionBy("path").orderBy("at", F.col("m").isNotNull())
    placed = starts.unionByName(ends, allowMissingColumns=True).withColumn(
        "chunk", F.last("chunk", ignorenulls=True).over(order)
    )
    held = (
        placed.where("m is not null").groupBy("path", "m")
        .agg(F.explode(F.sequence(F.min("chunk"), F.max("chunk"))).alias("chunk"))
        .select("path", "chunk", "m.*")
    )
    pieces = held.join(planned.select("path", "chunk", "start", "end"), ["path", "chunk"])
    found = pieces.select(
        "path", "chunk", "member", "offset", "stop",
        F.greatest("start", "offset").alias("begin"), F.least("end", "stop").alias("upto"),
    )
    return stage(found, "tar_pieces"), planned


def _read_pieces(
    pieces: DataFrame, planned: DataFrame, ddl: str,
    rows_of: Callable[[dict, dict, Iterator[bytes], bytes], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """The batches that ``rows_of`` makes of each piece; a chunk is opened once for all its pieces.

    A chunk holds no more members than it has blocks of 512 bytes. The function gets the
    piece, the chunk, the bytes from ``begin`` to the member's end, and those before ``begin``.
    """
    held = F.sort_array(F.collect_list(F.struct("begin", *[c for c in pieces.columns if c not in ("path", "chunk", "begin")])))
    rows = pieces.groupBy("path", "chunk").agg(held.alias("pieces")).join(planned, ["path", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = open_chunk(row)
                file = StretchFile(stream.pieces(), row["start"])
                for piece in row["pieces"]:
                    size = piece["stop"] - piece["begin"]
                    file.seek_to(piece["begin"], size)
                    before = stream.before if piece["begin"] > piece["offset"] else b""
                    yield from rows_of(piece, row, iter(lambda: file.read(byte_access.PIECE), b""), before)
                stream.close()

    return spread(rows).mapInArrow(run, ddl)


def _summed(pieces: DataFrame, planned: DataFrame, value: Callable) -> DataFrame:
    """``pieces`` with the sum of a value over the pieces of the member ahead of each.

    Only members longer than a chunk are read for it.
    """
    of = Window.partitionBy("path", "offset")
    long = pieces.withColumn("n", F.count("*").over(of)).where("n > 1").drop("n")

    def rows_of(piece, row, stream, before):
        found = value(stream, before, piece["begin"], piece["upto"])
        keys = {"path": row["path"], "chunk": row["chunk"], "offset": piece["offset"], "value": found}
        yield pa.RecordBatch.from_pylist([keys])

    counted = _read_pieces(long, planned, "path string, chunk long, offset long, value long", rows_of)
    past = of.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.withColumn("ahead", F.sum("value").over(past)).drop("value")
    joined = pieces.join(sums, ["path", "chunk", "offset"], "left")
    return joined.withColumn("ahead", F.coalesce("ahead", F.lit(0)))


def read_tar_lines(
    spark: SparkSession,
    path: str,
    suffix: str = ".csv",
    *,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Text lines of the members: ``(archive, member, line_no, line)`` (SRC11).

    A path may name many archives, plain or gzip. Lines of a member longer than a chunk
    are counted first, so that every task knows the number of its first one.
    """
    pieces, planned = _pieces(spark, path, suffix, index_dir, chunk_bytes)

    def count(stream, before, begin, upto) -> int:
        return sum(len(lines) for _, lines in lines_of(stream, before, begin, upto))

    def rows_of(piece, row, stream, before):
        number = piece["ahead"]
        for offsets, lines in lines_of(stream, before, piece["begin"], piece["upto"]):
            if offsets[0] == piece["offset"] and lines[0].startswith(_BOM):
                lines[0] = lines[0][len(_BOM) :]
            texts = [x.decode("utf-8", "replace") for x in lines]
            yield pa.RecordBatch.from_pydict(
                {
                    "archive": [row["path"]] * len(texts), "member": [piece["member"]] * len(texts),
                    "line_no": range(number, number + len(texts)), "line": texts,
                }
            )
            number += len(texts)

    ddl = "archive string, member string, line_no long, line string"
    return _read_pieces(_summed(pieces, planned, count), planned, ddl, rows_of)


def csv_lines(
    stream: Iterator[bytes], before: bytes, begin: int, upto: int, in_quotes: bool
) -> Iterator[str]:
    """Lines of the CSV records that begin from ``begin`` up to ``upto``, as a CSV parser takes them.

    A record begins after a line end outside quotes.
    """
    held, at = [], begin
    quoted, skipping = in_quotes, bool(before) and (in_quotes or not before.endswith(b"\n"))

    def lines() -> Iterator[bytes]:
        nonlocal held
        for piece in stream:
            held.append(piece)
            if b"\n" in piece:
                parts = b"".join(held).split(b"\n")
                held = [parts.pop()]
                for part in parts:
                    yield part + b"\n"
        if rest := b"".join(held):
            yield rest

    for line in lines():
        if not quoted and not skipping and at >= upto:
            return
        quoted ^= line.count(b'"') % 2 == 1
        if not skipping:
            text = line[len(_BOM) :] if at == begin and not before and line.startswith(_BOM) else line
            yield text.decode("utf-8", "replace")
        elif not quoted:
            skipping = False
        at += len(line)


def _quotes(stream, before, begin, upto) -> int:
    left, found = upto - begin, 0
    for piece in stream:
        found += piece[:left].count(b'"')
        left -= len(piece)
        if left <= 0:
            break
    return found


def _header(lines: Iterator[str]) -> list[str]:
    for record in csv.reader(lines):
        if any(c.strip() for c in record):
            return [c.strip() for c in record]
    return []


def _headers(pieces: DataFrame, planned: DataFrame) -> DataFrame:
    def rows_of(piece, row, stream, before):
        found = _header(csv_lines(stream, before, piece["begin"], piece["stop"], False))
        keys = {"archive": row["path"], "member": piece["member"], "offset": piece["offset"]}
        yield pa.RecordBatch.from_pylist([{**keys, "header": found or None}], schema)

    schema = pa.schema(
        [("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("header", pa.list_(pa.string()))]
    )
    first = pieces.where("begin = offset")
    return _read_pieces(first, planned, "archive string, member string, offset long, header array<string>", rows_of)


def tar_csv_headers(
    spark: SparkSession, path: str, *, index_dir: str | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Header of every CSV member: ``(archive, member, header)``; null where it is empty."""
    return _headers(*_pieces(spark, path, ".csv", index_dir, chunk_bytes)).drop("offset")


def read_tar_csv(
    spark: SparkSession,
    path: str,
    *,
    fill_missing: bool = False,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """CSV members as one table of text, values matched by the member's own header (SRC11).

    Every member is parsed as CSV, quoted line breaks included. Members may order their
    columns as they like; one with other columns is refused unless ``fill_missing``,
    which gives the columns of all and null where a member has none. A member longer
    than a chunk must quote whole fields and double the quotes inside, as usual.
    """
    pieces, planned = _pieces(spark, path, ".csv", index_dir, chunk_bytes)
    headers = stage(_headers(pieces, planned).where("header is not null"), "tar_headers")
    sets = headers.selectExpr("array_sort(array_distinct(header)) as names").distinct()
    some = sets.limit(2).collect()
    if not some:
        raise FileNotFoundError(f"no CSV member in {path}")
    if len(some) > 1 and not fill_missing:
        raise ValueError(f"members of {path} differ in columns: {some[0][0]} and {some[1][0]}")
    names = list(headers.orderBy("archive", "offset").select("header").first()[0])
    names = list(dict.fromkeys(names))
    every = sets.select(F.explode("names").alias("name")).distinct().orderBy("name").collect()
    names += [r["name"] for r in every if r["name"] not in names]

    def rows_of(piece, row, stream, before):
        header, first = piece["header"], piece["begin"] == piece["offset"]
        lines = csv_lines(stream, before, piece["begin"], piece["upto"], piece["ahead"] % 2 == 1)
        rows = []
        for record in csv.reader(lines):
            if not any(c.strip() for c in record):
                continue
            if first:
                first = False
                continue
            values = dict(zip(header, record))
            rows.append([values.get(n) or None for n in names])
            if len(rows) == _BATCH:
                yield _text_batch(names, rows)
                rows = []
        if rows:
            yield _text_batch(names, rows)

    told = _summed(pieces, planned, _quotes)
    own = headers.select(F.struct(F.col("archive").alias("path"), "offset").alias("of"), "header")
    with_header = splittable_join(told.withColumn("of", F.struct("path", "offset")), own, "of", "inner").drop("of")
    return _read_pieces(with_header, planned, ", ".join(f"`{n}` string" for n in names), rows_of)


def _text_batch(names: list[str], rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def shard_ndjson(
    spark: SparkSession,
    source: str,
    target: str,
    target_mb: int = 100,
    parts: int | None = None,
    index_dir: str | None = None,
) -> DataFrame:
    """Split one line-delimited file into many and read them back (SRC12).

    A finished target is left alone; one that a lost job left unfinished is written
    anew. A gzip file is read by one task, or with ``index_dir`` by many once its
    index is there; ``parts`` spreads the writing over that many.
    """
    if not is_finished(spark, target):
        if index_dir:
            lines = read_lines(spark, source, index_dir=index_dir).select("value")
        else:
            lines = spark.read.text(source)
        if parts:
            lines = lines.repartition(parts)
        limit = max(MIN_LINES_PER_SHARD, target_mb * LINES_PER_TARGET_MB)
        lines.write.mode("overwrite").option("maxRecordsPerFile", limit).text(target)
    return spark.read.text(target)


def is_finished(spark: SparkSession, folder: str) -> bool:
    """Whether a writer has finished this folder."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_SUCCESS")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return marker.getFileSystem(conf).exists(marker)
