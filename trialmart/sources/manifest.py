"""What is in raw files and whether it is whole (SRC8, SRC9, SRC10).

One task reads one file, as a stream. What is wrong with a file becomes a row; what is
wrong with the job (a store that cannot be reached, a lost executor, a missing path)
stays an error of the job and is never taken for a broken file.
"""

from __future__ import annotations

import io
import re
import sys
import tarfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .byte_access import StretchFile, StrictMember, locate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEP = 1 << 16
_MAX_GIVEN = 1 << 22
_FIRST_MEMBERS = 5
_MOST_TASKS = 20_000

COLUMNS = (
    "path string, name string, size_bytes long, kind string, ok boolean, members long, "
    "content_bytes long, lines long, crc32 long, first_char string, first_members array<string>, "
    "broken_at long, problem string"
)


class _Content:
    """Decompressed bytes of a file, counted as they pass; ends where the file breaks."""

    def __init__(self, file, gzip: bool):
        self._file, self._gzip = file, gzip
        self.size = self.lines = self.crc = self.members = 0
        self.last = self.first = b""
        self.broken_at: int | None = None
        self.problem: str | None = None

    def pieces(self) -> Iterator[bytes]:
        for piece in self._inflated() if self._gzip else iter(lambda: self._file.read(_STEP), b""):
            self.size += len(piece)
            self.lines += piece.count(b"\n")
            self.crc, self.last = zlib.crc32(piece, self.crc), piece[-1:]
            if not self.first:
                ahead = piece if self.size > len(piece) else piece.removeprefix(b"\xef\xbb\xbf")
                self.first = ahead.lstrip()[:4]
            yield piece

    def _broken(self, at: int, problem: str) -> None:
        self.broken_at, self.problem = at, problem

    def _inflated(self) -> Iterator[bytes]:
        read, inflate, block = 0, None, b""  # bytes of the file ahead of ``block``
        while True:
            if not block and not (block := self._file.read(_STEP)):
                break
            if inflate is None:
                held = block.lstrip(b"\0") if self.members else block
                read += len(block) - len(held)
                block = held
                if not block:
                    continue
                inflate = zlib.decompressobj(31)
            before = inflate.copy()
            given = []
            try:
                given.append(inflate.decompress(block, _MAX_GIVEN))
                while inflate.unconsumed_tail and not inflate.eof:
                    yield given.pop()
                    before = None  # part of the block has passed
                    given.append(inflate.decompress(inflate.unconsumed_tail, _MAX_GIVEN))
            except zlib.error as error:
                at = read + (_first_bad(before, block) if before is not None else len(block))
                self._broken(at, str(error).rpartition(": ")[2])
                return
            yield from given
            used = len(block) - len(inflate.unused_data)
            read, block = read + used, block[used:]
            if inflate.eof:
                self.members, inflate = self.members + 1, None
        if inflate is not None:
            self._broken(read, "the file ends inside a gzip member")
        elif not self.members:
            self._broken(0, "the file is empty")


def _first_bad(inflate, block: bytes) -> int:
    """Place of the byte at which decompression fails."""
    for i in range(len(block)):
        try:
            inflate.decompress(block[i : i + 1])
        except zlib.error:
            return i
    return len(block)


def _tar_names(content: _Content, limit: int | None) -> tuple[int, list[str]]:
    """Number of files in an archive and the first of their names; problems go to ``content``."""
    stream = StretchFile(content.pieces(), 0)
    stream.seek_to(0, sys.maxsize, open_end=True)
    count, names, tar = 0, [], None
    try:
        tar = tarfile.open(fileobj=io.BufferedReader(stream), mode="r|", tarinfo=StrictMember)
        while (limit is None or count < limit) and (member := tar.next()) is not None:
            tar.members.clear()
            if member.isfile():
                count += 1
                names += [member.name][: max(0, _FIRST_MEMBERS - len(names))]
    except tarfile.TarError as error:
        at = tar.offset if tar else 0
        if content.problem is None and content.size < at:
            content._broken(content.size, "the archive ends inside a member")
        elif content.problem is None:
            content._broken(at, f"no valid member header: {error}")
        return count, names
    if limit is None:
        while stream.read(_STEP):
            pass
        if content.problem is None and content.size < tar.offset:
            content._broken(content.size, "the archive ends inside a member")
    return count, names


def check_file(path: str, whole: bool = True) -> dict:
    """One row of the manifest. Unless ``whole``, only the beginning is read."""
    store, name = locate(path)
    size = store.get_file_info(name).size
    short = path.rpartition("/")[2]
    gzip = short.endswith((".gz", ".tgz"))
    tar = short.removesuffix(".gz").endswith((".tar", ".tgz"))
    with store.open_input_stream(name, compression=None) as file:
        content, count, names = _Content(file, gzip), None, None
        if tar:
            count, names = _tar_names(content, None if whole else _FIRST_MEMBERS)
        else:
            for _ in content.pieces():
                if not whole and content.first:
                    break
    lines = content.lines + (content.last not in (b"", b"\n"))
    first = content.first.decode("utf-8", "ignore")[:1] or None
    kind = ("tar.gz" if gzip else "tar") if tar else "gzip" if gzip else "plain"
    return {
        "path": path, "name": short, "size_bytes": size, "kind": kind,
        "ok": content.problem is None, "members": count if tar else content.members if gzip and whole else None,
        "content_bytes": content.size if whole else None,
        "lines": lines if whole and not tar else None,
        "crc32": content.crc if whole else None,
        "first_char": None if tar else first, "first_members": names,
        "broken_at": content.broken_at, "problem": content.problem,
    }


def file_manifest(
    spark: SparkSession, path: str, *, pattern: str | None = None, whole: bool = True
) -> DataFrame:
    """One row for each file below a path: kind, members, length, CRC-32, lines, and where it breaks.

    gzip members are held against their own checksums and lengths. Counts of a broken
    file are those up to the break; ``broken_at`` counts the file's bytes, for a wrong
    member header of an archive those of its content. ``members`` are files of an
    archive, else gzip members. Unless ``whole``, only the beginning of each file is
    read, and what needs all of it is null. A path without files gives no row, a missing one
    is an error.
    """
    schema = to_arrow_schema(StructType.fromDDL(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = check_file(row["path"], whole)
                yield pa.RecordBatch.from_pylist([found], schema)

    # Spark's listing in rows leaves empty files out; the index it holds has them.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    paths = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in reader.load(path).inputFiles()]
    files = spark.createDataFrame(paths, "path string")
    return files.repartition(max(1, min(len(paths), _MOST_TASKS))).mapInArrow(run, COLUMNS)


def broken_files(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.col("ok")).select("path", "broken_at", "problem").orderBy("path")
