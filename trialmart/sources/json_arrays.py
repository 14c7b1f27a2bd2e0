"""JSON arrays read by many tasks (SRC3).

An array has no line to split at, and a task that starts in the middle knows neither
whether it is inside a string nor how deep. So each file is read in two passes over
its chunks (``byte_access``; gzip files by their index), both in parallel:

1. Every chunk counts its quotes, and the brackets it opens less those it closes,
   once as if it began outside a string and once as if inside. Running sums over the
   chunks of a file tell how each of them really begins.
2. Every chunk cuts out the elements whose opening bracket or comma at depth one
   lies in it; the last one is finished from the bytes behind the chunk.

No task holds more than some pieces and one element.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_access import CHUNK_BYTES, open_chunk, spread_chunks
from .gzip_index import chunks
from .storage import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUOTE, _ESCAPE, _COMMA = 0x22, 0x5C, 0x2C
_STEP_OF = np.zeros(256, np.int8)
_STEP_OF[[0x5B, 0x7B]] = 1
_STEP_OF[[0x5D, 0x7D]] = -1
_MARK = _STEP_OF != 0
_MARK[_COMMA] = True
_BATCH_BYTES = 4 << 20


class Scanner:
    """Marks of a stream of bytes, and whether each is inside a string.

    ``before`` is what precedes the stream: a run of backslashes may go on into it.
    """

    def __init__(self, before: bytes, in_string: bool = False):
        self._escapes = len(before) - len(before.rstrip(b"\\"))
        if self._escapes and self._escapes == len(before):
            raise ValueError("a run of backslashes is longer than the bytes kept of a chunk's past")
        self.in_string = in_string

    def marks(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of brackets, braces and commas, their bytes, and which are inside strings."""
        data = np.frombuffer(piece, np.uint8)
        quotes = self._quotes(data)
        at = np.flatnonzero(_MARK[data])
        inside = (np.searchsorted(quotes, at) + self.in_string) % 2 == 1
        self.in_string = (len(quotes) + self.in_string) % 2 == 1
        return at, data[at], inside

    def _quotes(self, data: np.ndarray) -> np.ndarray:
        """Quotes that do not follow an odd number of backslashes."""
        quotes = np.flatnonzero(data == _QUOTE)
        escapes = np.flatnonzero(data == _ESCAPE)
        ahead, self._escapes = self._escapes, 0
        if not len(escapes):
            return quotes[1:] if ahead % 2 and len(quotes) and quotes[0] == 0 else quotes
        starts = escapes[np.flatnonzero(np.diff(escapes, prepend=-2) != 1)]
        ends = escapes[np.flatnonzero(np.diff(escapes, append=-2) != 1)] + 1
        lengths = ends - starts
        if starts[0] == 0:
            lengths[0] += ahead
        elif ahead % 2 and len(quotes) and quotes[0] == 0:
            quotes = quotes[1:]
        if ends[-1] == len(data):
            self._escapes = int(lengths[-1])
        run = np.searchsorted(ends, quotes)
        run[run == len(ends)] = 0
        return quotes[(ends[run] != quotes) | (lengths[run] % 2 == 0)]


def _upto(stream, end: int, start: int) -> Iterator[bytes]:
    left = end - start
    for piece in stream.pieces():
        yield piece[:left]
        left -= len(piece)
        if left <= 0:
            return


def _summary(row: dict) -> tuple[int, int, int]:
    """Parity of the quotes of a chunk, and its change of depth if it begins outside or inside a string."""
    stream = open_chunk(row)
    scanner, quoted, depth = Scanner(stream.before), False, [0, 0]
    for piece in _upto(stream, row["end"], row["start"]):
        _, kinds, inside = scanner.marks(piece)
        steps = _STEP_OF[kinds].astype(np.int64)
        depth[0] += int(steps[~inside].sum())
        depth[1] += int(steps[inside].sum())
    quoted = scanner.in_string
    stream.close()
    return int(quoted), depth[0], depth[1]


def elements(row: dict) -> Iterator[bytes]:
    """The elements that a chunk begins, given ``in_string`` and ``depth`` at its start."""
    stream = open_chunk(row)
    scanner, depth = Scanner(stream.before, row["in_string"]), row["depth"]
    held: list[bytes] | None = None  # the element at hand, if the chunk owns it
    at, end, first = row["start"], row["end"], row["start"] == 0
    for piece in stream.pieces():
        if at >= end and held is None:
            break
        places, kinds, inside = scanner.marks(piece)
        places, kinds = places[~inside], kinds[~inside]
        steps = _STEP_OF[kinds].astype(np.int64)
        after = depth + np.cumsum(steps)
        if first and piece.strip():
            if piece.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] != b"[":
                raise ValueError(f"{row['path']} is no JSON array")
            first = False
        border = ((steps > 0) & (after == 1)) | ((steps < 0) & (after == 0)) | ((steps == 0) & (after == 1))
        depth = int(after[-1]) if len(after) else depth
        begin = 0
        for place, step in zip(places[border].tolist(), steps[border].tolist()):
            if held is not None:
                held.append(piece[begin:place])
                text = b"".join(held).strip()
                if text:
                    yield text
                held = None
            begin = place + 1
            if at + place >= end:
                break
            if step >= 0:
                held = []
        if held is not None:
            held.append(piece[begin:])
        at += len(piece)
    if held is not None:
        raise ValueError(f"{row['path']} ends inside its array")
    stream.close()


def array_elements(
    spark: SparkSession,
    path: str,
    *,
    pattern: str | None = None,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(path, value)``: the JSON text of every element of the arrays in the files below ``path``.

    Line breaks between tokens become blanks. An empty file or array has no element; a file
    that is no array, or ends before its array does, is refused by name.
    """
    planned = stage(
        chunks(spark, path, pattern=pattern, index_dir=index_dir, chunk_bytes=chunk_bytes), "json_chunks"
    )

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = (row["path"], row["chunk"], *_summary(row))
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, values)})

    names = ("path", "chunk", "quoted", "outside", "inside")
    found = stage(
        spread_chunks(planned).mapInArrow(summaries, "path string, chunk long, quoted long, outside long, inside long"),
        "json_summaries",
    )
    # How many chunks a file has is bounded by its size, and a row is five numbers.
    past = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = found.withColumn("in_string", F.coalesce(F.sum("quoted").over(past), F.lit(0)) % 2 == 1)
    step = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    begun = begun.withColumn("step", step).select(
        "path", "chunk", "in_string", F.coalesce(F.sum("step").over(past), F.lit(0)).alias("depth")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_pydict({"path": [row["path"]] * len(texts), "value": texts})

        for batch in batches:
            for row in batch.to_pylist():
                texts, size = [], 0
                for element in elements(row):
                    text = element.decode("utf-8", "replace").replace("\r", " ").replace("\n", " ")
                    texts.append(text)
                    size += len(text)
                    if size > _BATCH_BYTES:
                        yield made()
                        texts, size = [], 0
                if texts:
                    yield made()

    return spread_chunks(planned.join(begun, ["path", "chunk"])).mapInArrow(cut, "path string, value string")


def read_json_array(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    **options,
) -> DataFrame:
    """The objects of JSON arrays as rows.

    Without a schema all keys become text columns, found by one more pass; nested values
    arrive as their JSON text.
    """
    found = array_elements(spark, path, **options)
    if schema is None:
        found = stage(found, "json_elements")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in keys_of(found)])
    return found.select(F.from_json("value", schema).alias("row")).select("row.*")


def keys_of(found: DataFrame) -> list[str]:
    """Names of all keys of the objects, in order."""
    names = found.select(F.explode(F.json_object_keys("value")).alias("name")).distinct()
    return [r["name"] for r in names.orderBy("name").collect()]
