"""Pieces of files that tasks read on their own, plain or gzip, wherever pyarrow reads.

``chunks`` plans them as a table: byte ranges of plain files, and for gzip files the
stretches between the access points of a stored index (``gzip_index``). Offsets
always count decompressed bytes. ``open_chunk`` gives the bytes from the start of a
chunk on, past its end if the caller goes on, so what is torn at a border is
finished by the task that began it. ``before`` has some bytes ahead of the start.
"""

from __future__ import annotations

import io
import sys
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 32 << 20
PIECE = 1 << 20
BEFORE = 1 << 15
_FEW_TASKS = 64
# A member's first access point is its gzip header; others begin inside the stream.
MEMBER_START = -1

CHUNK_COLUMNS = (
    "path string, chunk long, start long, end long, at_byte long, at_bit int, "
    "member_end long, crc long, window binary"
)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:") :]
    return fs.LocalFileSystem(), path


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, size, modified)`` of the files below a path, hidden ones left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified")
    )


def spread(rows: DataFrame, at_most: int = 20_000) -> DataFrame:
    """The rows, one to a task as far as that goes."""
    return rows.repartition(max(1, min(rows.count(), at_most)))


def spread_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks ``(start, end)`` dealt out: one to a task while tasks are few, then ``CHUNK_BYTES`` of them."""
    n, size = chunks.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    return chunks.repartition(max(1, min(n, max(_FEW_TASKS, (size or 0) // CHUNK_BYTES))))


def plain_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Byte ranges of uncompressed files ``(path, size)``; an empty file has none."""
    step = F.lit(chunk_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)
    ranges = files.where("size > 0").select("path", "size", F.posexplode(starts).alias("chunk", "start"))
    none = {"at_byte": "long", "at_bit": "int", "member_end": "long", "crc": "long", "window": "binary"}
    return ranges.select(
        "path", F.col("chunk").cast("long").alias("chunk"), "start",
        F.least(F.col("start") + step, F.col("size")).alias("end"),
        *[F.lit(None).cast(t).alias(n) for n, t in none.items()],
    )


def shifted(data: np.ndarray, bits: int) -> bytes:
    """The bytes that begin ``bits`` bits into ``data``, one fewer unless that is 0."""
    if not bits:
        return data.tobytes()
    return ((data[:-1] >> bits) | (data[1:] << (8 - bits))).astype(np.uint8).tobytes()


class PlainChunk:
    """Bytes of an uncompressed file from ``start`` on."""

    def __init__(self, path: str, start: int, end: int):
        store, name = locate(path)
        self._file = store.open_input_file(name)
        self._left = end - start
        begin = max(0, start - BEFORE)
        self._file.seek(begin)
        self.before = self._file.read(start - begin)

    def pieces(self) -> Iterator[bytes]:
        while piece := self._file.read(min(PIECE, self._left if self._left > 0 else 2 * BEFORE)):
            self._left -= len(piece)
            yield piece

    def close(self) -> None:
        self._file.close()


class GzipChunk:
    """Decompressed bytes of a gzip file from an access point on, through all later members.

    The bytes up to the chunk's end are held against its checksum.
    """

    def __init__(self, path: str, row: dict):
        store, name = locate(path)
        self._path, self._row = path, row
        # No more than a short chunk needs is read and decompressed at once.
        size = row["end"] - row["start"]
        self._block, self._given = min(PIECE, max(BEFORE, size // 8)), min(4 * PIECE, max(BEFORE, size // 2))
        self._file = store.open_input_file(name)
        self.before = bytes(row["window"] or b"")

    def pieces(self) -> Iterator[bytes]:
        left, crc = self._row["end"] - self._row["start"], 0
        for piece in self._decompressed():
            if left > 0:
                crc = zlib.crc32(piece[:left], crc)
                left -= len(piece)
                if left <= 0:
                    self._check(crc)
            yield piece
        if left > 0:
            raise ValueError(f"{self._path} ends early: it has changed since it was indexed")

    def _check(self, crc: int) -> None:
        if crc != self._row["crc"]:
            raise ValueError(f"{self._path} has changed since it was indexed, or is damaged")

    def _decompressed(self) -> Iterator[bytes]:
        row = self._row
        self._file.seek(row["at_byte"])
        if row["at_bit"] != MEMBER_START:
            yield from self._rest_of_member(row["at_bit"])
            self._file.seek(row["member_end"])
        yield from members(self._file, self._block, self._given)

    def _rest_of_member(self, bits: int) -> Iterator[bytes]:
        inflate = zlib.decompressobj(-15, zdict=self.before)
        rest = b""
        while block := self._file.read(self._block):
            data = np.frombuffer(rest + block, np.uint8)
            rest = (rest + block)[-1:] if bits else b""
            yield from _bounded(inflate, shifted(data, bits), self._given)
            if inflate.eof:
                return
        yield from _bounded(inflate, bytes([rest[0] >> bits]) if rest else b"", self._given)
        if not inflate.eof:
            raise EOFError(f"{self._path} ends inside a gzip member")

    def close(self) -> None:
        self._file.close()


def _bounded(inflate, data: bytes, given: int) -> Iterator[bytes]:
    """Decompressed data in pieces of limited size, whatever the ratio."""
    while data or inflate.unconsumed_tail:
        piece = inflate.decompress(data or inflate.unconsumed_tail, given)
        data = inflate.unconsumed_tail
        if piece:
            yield piece
        if inflate.eof or (not piece and not data):
            return
    while not inflate.eof and (piece := inflate.decompress(b"", given)):
        yield piece


def members(file, block: int = PIECE, given: int = 4 * PIECE) -> Iterator[bytes]:
    """Decompressed bytes of all gzip members from the file's position on."""
    rest = b""
    while True:
        while not rest.strip(b"\0"):  # the next member, or padding up to the end
            if not (rest := file.read(block)):
                return
        rest = rest.lstrip(b"\0")
        inflate = zlib.decompressobj(31)
        while True:
            yield from _bounded(inflate, rest, given)
            if inflate.eof:
                rest = inflate.unused_data
                break
            if not (rest := file.read(block)):
                raise EOFError("a gzip member has no end")


def open_chunk(row: dict) -> PlainChunk | GzipChunk:
    if row["at_byte"] is None:
        return PlainChunk(row["path"], row["start"], row["end"])
    return GzipChunk(row["path"], row)


class StretchFile(io.RawIOBase):
    """A stretch of a chunk's bytes as a file; skips forward to its offset, never back."""

    def __init__(self, pieces: Iterator[bytes], at: int):
        self._pieces, self._at, self._held, self._left = pieces, at, b"", 0
        self._open_end = False

    def seek_to(self, offset: int, size: int, open_end: bool = False) -> None:
        """The stretch to read next; offsets must not go back. ``open_end``: up to all there is."""
        self._open_end = open_end
        while self._at < offset:
            if not self._held:
                self._held = next(self._pieces, b"")
                if not self._held:
                    raise EOFError("the archive ends inside a member")
            step = min(len(self._held), offset - self._at)
            self._held, self._at = self._held[step:], self._at + step
        self._left = size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self._left:
            return 0
        if not self._held:
            self._held = next(self._pieces, b"")
            if not self._held and self._open_end:
                return 0
            if not self._held:
                raise EOFError("the archive ends inside a member")
        size = min(len(buffer), len(self._held), self._left)
        buffer[:size] = self._held[:size]
        self._held, self._at, self._left = self._held[size:], self._at + size, self._left - size
        return size


class StrictMember(tarfile.TarInfo):
    """A damaged member header is an error, where ``tarfile`` takes it for the end of the archive."""

    @classmethod
    def fromtarfile(cls, tar):
        try:
            return super().fromtarfile(tar)
        except (tarfile.EOFHeaderError, tarfile.EmptyHeaderError):
            raise
        except tarfile.HeaderError as error:
            raise tarfile.ReadError(f"{error} at byte {tar.offset}") from error
