"""Access points into gzip files, so that many tasks can read one file (SRC12, SRC2).

A gzip stream can be entered at the start of a deflate block if the 32 KB before it are
known. One pass over a file finds such a place every ``spacing`` decompressed bytes:
blocks begin at any bit, so all bit positions of a stretch are tested for a valid
block header, and one that decompresses to just what the pass itself reads next is
taken. A row of the index holds the place, the 32 KB, and the checksum of the bytes
up to the next place, which every later read is held against. Where no block of
the common kind begins, a chunk is longer; starts of members are always places.

The first reading of a file is one task; that is the price of the format, paid once.
Indexes are kept in a folder the caller names, with size and time of the files.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import splittable_join
from .byte_access import (
    BEFORE,
    CHUNK_BYTES,
    CHUNK_COLUMNS,
    MEMBER_START,
    listing,
    locate,
    open_chunk,
    plain_chunks,
    shifted,
    spread,
    spread_chunks,
)
from .storage import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEP = 1 << 16
_AHEAD = 1 << 18
_PROOF = 1 << 13
_TRIED = 1 << 17
_LOOK = 1 << 15
# Deflate: 3 bits of block header, three counts, then 3 bits for each code length.
_COUNTS_AT, _LENGTHS_AT, _MAX_LENGTHS = 3, 17, 19


def block_starts(data: np.ndarray) -> np.ndarray:
    """Bit positions where a block with its own codes may begin.

    Not the last block of the stream, counts in range, and code lengths that make
    a complete prefix code: what the format asks of the first bits.
    """
    bits = np.unpackbits(data, bitorder="little")
    usable = len(bits) - _LENGTHS_AT - 3 * _MAX_LENGTHS
    if usable <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((bits[:usable] == 0) & (bits[1 : usable + 1] == 0) & (bits[2 : usable + 2] == 1))

    def number(first: int, size: int) -> np.ndarray:
        return sum(bits[at + first + k].astype(np.int64) << k for k in range(size))

    at = at[(number(_COUNTS_AT, 5) <= 29) & (number(_COUNTS_AT + 5, 5) <= 29)]
    given = number(_COUNTS_AT + 10, 4) + 4
    room = np.zeros(len(at), np.int64)
    for k in range(_MAX_LENGTHS):
        length = number(_LENGTHS_AT + 3 * k, 3)
        room += np.where((k < given) & (length > 0), 128 >> length, 0)
    return at[room == 128]


def _starts_in(ahead: np.ndarray) -> Iterator[int]:
    """The same for a long stretch, a part at a time: mostly the first part has one."""
    header = (_LENGTHS_AT + 3 * _MAX_LENGTHS + 3 + 7) // 8
    for begin in range(0, len(ahead), _LOOK):
        found = block_starts(ahead[begin : begin + _LOOK + header])
        yield from (8 * begin + found[found < 8 * _LOOK]).tolist()


def _enter(ahead: np.ndarray, inflate, tail: bytes) -> tuple[int, bytes, bytes] | None:
    """First place in ``ahead`` where a block begins: bit, bytes up to it, 32 KB before it.

    ``inflate`` has read all before ``ahead``, ``tail`` is the end of what it gave.
    """
    for bit in _starts_in(ahead):
        if not bit:
            continue
        byte = (bit - 1) // 8 + 1  # up to the last bit of the block before
        rest = ahead[bit // 8 : bit // 8 + (_STEP << 1) + 1]
        guess = zlib.decompressobj(-15, zdict=b"\0" * BEFORE)
        try:
            if len(guess.decompress(shifted(rest[: 1 << 10], bit % 8))) < 8:
                continue
        except zlib.error:
            continue
        true = inflate.copy()
        passed = true.decompress(ahead[:byte].tobytes())
        if true.eof:
            return None
        window = (tail + passed)[-BEFORE:]
        after = true.decompress(ahead[byte:].tobytes(), _TRIED)
        guess = zlib.decompressobj(-15, zdict=window)
        try:
            tried = guess.decompress(shifted(rest, bit % 8), _TRIED)
        except zlib.error:
            continue
        proof = min(len(tried), len(after))
        if proof >= _PROOF and tried[:proof] == after[:proof]:
            return bit, passed, window
    return None


def scan(file, spacing: int) -> Iterator[dict]:
    """Rows of the index of one gzip file, chunk by chunk, and one for each member's end."""
    held, read = b"", 0  # bytes from the file not yet used, bytes used
    out, chunk, member = 0, 0, 0
    inflate, tail, point, crc, wait = None, b"", None, 0, 0

    def more(size: int) -> bool:
        nonlocal held
        while len(held) < size and (block := file.read(_AHEAD)):
            held += block
        return bool(held)

    def closed() -> dict:
        return {**point, "chunk": chunk, "end": out, "crc": crc}

    while more(_AHEAD):
        if inflate is None:
            zeros = len(held) - len(held.lstrip(b"\0"))
            if zeros:  # padding between members
                held, read = held[zeros:], read + zeros
                continue
            inflate = zlib.decompressobj(31)
            if point is None or out >= wait:  # small members share a chunk
                if point is not None:
                    yield closed()
                    chunk += 1
                point = {"member": member, "start": out, "at_byte": read, "at_bit": MEMBER_START, "window": tail}
                crc, wait = 0, out + spacing
        if out >= wait:
            found = _enter(np.frombuffer(held[:_AHEAD], np.uint8), inflate, tail)
            if found:
                bit, passed, window = found
                byte = (bit - 1) // 8 + 1
                inflate.decompress(held[:byte])
                crc, out = zlib.crc32(passed, crc), out + len(passed)
                yield closed()
                point = {
                    "member": member, "start": out, "at_byte": read + bit // 8, "at_bit": bit % 8,
                    "window": window,
                }
                held, read, tail, crc, chunk = held[byte:], read + byte, window, 0, chunk + 1
            wait = out + (spacing if found else max(spacing // 8, 1))
        block = held[:_STEP]
        given = inflate.decompress(block)
        used = len(block) - len(inflate.unused_data)
        held, read = held[used:], read + used
        crc, out, tail = zlib.crc32(given, crc), out + len(given), (tail + given)[-BEFORE:]
        if inflate.eof:
            if point["member"] == member:
                yield {"member": member, "member_end": read}
            inflate, member = None, member + 1
    if inflate is not None:
        raise EOFError("a gzip member has no end")
    if point is not None:
        yield closed()


def build_index(files: DataFrame, spacing: int) -> DataFrame:
    """Rows ``path, size, modified`` and those of ``scan``; one task for each file."""
    ddl = (
        "path string, size long, modified long, chunk long, member long, start long, end long, "
        "at_byte long, at_bit int, member_end long, crc long, window binary"
    )
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = locate(row["path"])
                with store.open_input_stream(name, compression=None) as file:
                    for found in _named(scan(file, spacing), row["path"]):
                        made = {**dict.fromkeys(names), **row, **found}
                        yield pa.RecordBatch.from_pydict({n: [made[n]] for n in names}, schema)

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    found = spread(files.select("path", "size", "modified")).mapInArrow(run, ddl)
    rows = stage(found.withColumn("of", F.struct("path", "member")), "gzip_scan")
    ends = rows.where("member_end is not null").select("of", "member_end")
    points = rows.where("member_end is null").drop("member_end")
    return splittable_join(points, ends, "of", "inner").drop("of", "member")


def _named(rows: Iterator[dict], path: str) -> Iterator[dict]:
    try:
        yield from rows
    except (zlib.error, EOFError) as broken:
        raise ValueError(f"{path} cannot be decompressed: {broken}") from broken


def gzip_index(
    spark: SparkSession, files: DataFrame, index_dir: str | None = None, spacing: int = CHUNK_BYTES
) -> DataFrame:
    """The index of gzip ``files (path, size, modified)``, made where it is missing or out of date.

    Without ``index_dir`` it is staged for the session and made anew by each call.
    """
    if index_dir is None:
        return stage(build_index(files, spacing), "gzip_index").select(*_names())
    keys = ["path", "size", "modified"]
    try:
        known = spark.read.parquet(index_dir)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        known = None
    new = files if known is None else files.join(known.select(*keys).distinct(), keys, "left_anti")
    if not new.isEmpty():
        build_index(new, spacing).write.mode("append").parquet(index_dir)
        known = spark.read.parquet(index_dir)
    if known is None:  # no file at all
        return build_index(files, spacing).select(*_names())
    # Two calls at once may both have indexed a file.
    return known.join(files.select(*keys), keys, "left_semi").dropDuplicates(["path", "chunk"]).select(*_names())


def _names() -> list[str]:
    return [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]


def chunks(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = None,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The pieces of all files below ``path``: gzip by their index, others by byte ranges."""
    files = listing(spark, path, pattern)
    plain = files.where(~F.col("path").rlike(r"\.(gz|tgz)$"))
    packed = files.where(F.col("path").rlike(r"\.(gz|tgz)$"))
    found = plain_chunks(plain, chunk_bytes)
    if not packed.isEmpty():
        found = found.unionByName(gzip_index(spark, packed, index_dir, chunk_bytes))
    return found


def read_lines(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = None,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(path, offset, value)``: the lines of text files, each chunk read by a task of its own.

    Lines are those of ``spark.read.text``; a line belongs to the chunk it begins in.
    ``offset`` is its first byte, so (path, offset) puts lines in order. Bytes that are
    not UTF-8 become replacement characters.
    """
    planned = chunks(spark, path, pattern=pattern, index_dir=index_dir, chunk_bytes=chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = open_chunk(row)
                for offsets, lines in lines_of(stream.pieces(), stream.before, row["start"], row["end"]):
                    texts = [x.decode("utf-8", "replace") for x in lines]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [row["path"]] * len(lines), "offset": offsets, "value": texts}
                    )
                stream.close()

    return spread_chunks(planned).mapInArrow(run, "path string, offset long, value string")


def lines_of(
    pieces: Iterator[bytes], before: bytes, start: int, end: int
) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and texts of the lines that begin from ``start`` up to ``end``.

    A line ends with a line feed, a carriage return, or both.
    """
    held, at, skipping = [], start, bool(before) and not before.endswith((b"\n", b"\r"))
    first = before.endswith(b"\r")
    for piece in pieces:
        if first and piece.startswith(b"\n"):  # the second half of a line end
            piece, at = piece[1:], at + 1
        first = False
        held.append(piece)
        if b"\n" not in piece and b"\r" not in piece and not held[-2:][0].endswith(b"\r"):
            continue
        parts = b"".join(held).splitlines(keepends=True)
        # The last part may go on, or be the first half of a line end.
        held = [parts.pop()] if parts and not parts[-1].endswith(b"\n") else []
        offsets, lines = [], []
        for part in parts:
            if skipping:
                skipping = False
            elif at < end:
                offsets.append(at)
                lines.append(part.rstrip(b"\r\n"))
            at += len(part)
        if lines:
            yield offsets, lines
        if at >= end:
            return
    if held and not skipping and at < end:
        yield [at], [b"".join(held).rstrip(b"\r\n")]
