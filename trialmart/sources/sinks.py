"""Writers of silver and result tables."""

from __future__ import annotations

import csv
import gzip
import io
import sys
import tarfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_access import PIECE, locate, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_sharded_json(df: DataFrame, path: str, parts: int) -> None:
    """Orders as JSON in a given number of files (SNK1)."""
    df.repartition(parts).write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, parts: int, compression: str | None = None) -> None:
    """Rows as JSON arrays, one array to a file, an element to a line."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for text in batch.column(0).to_pylist():
                lines.append(lead + text)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]" if lead == "," else "[]"]})

    rows = df.repartition(parts).select(F.to_json(F.struct("*")).alias("value"))
    writer = rows.mapInArrow(bracketed, "value string").write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_gzip_files(
    df: DataFrame, folder: str, names: Sequence[str], kind: str, parts: int, *, header: bool = False
) -> None:
    """Rows as gzip files of the given names, ``json`` lines or ``csv``, written by ``parts`` tasks.

    What the tasks write are gzip members, and a file is several of them one after the
    other. Where the store is a mounted folder each is copied to its place by a task of its
    own; other stores only take a file from its start to its end, so there a file is one
    task's, which holds some bytes at a time.
    """
    top = folder.rstrip("/")
    made = f"{top}/_parts-{uuid.uuid4().hex}"
    getattr(df.repartition(parts).write.option("compression", "gzip"), kind)(made)
    store, base = locate(top)
    _, below = locate(made)
    found = sorted((f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(below)))
    found = [(f"{made}/{name}", size) for name, size in found if name.startswith("part-") and size]
    record = io.StringIO()
    csv.writer(record, lineterminator="\n").writerow(df.columns)
    first = gzip.compress(record.getvalue().encode() if header else b"")
    copies: list[tuple[str, str, int]] = []
    for number, name in enumerate(names):
        own = found[number :: len(names)]
        begin = len(first) if header or not own else 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(first[:begin])
        for path, size in own:
            copies.append((f"{top}/{name}", path, begin))
            begin += size
    if copies:
        _put_together(df.sparkSession.createDataFrame(copies, "file string, part string, begin long"), store, first if header else b"")
    store.delete_dir(below)


def _put_together(copies: DataFrame, store: fs.FileSystem, first: bytes) -> None:
    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(locate(row["file"])[1], "r+b") as out:
                    out.seek(row["begin"])
                    _copy(row["part"], out)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]]})

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, name = locate(row["file"])
                with own.open_output_stream(name, compression=None) as out:
                    out.write(first)
                    for part in row["parts"]:
                        _copy(part["part"], out)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]]})

    if isinstance(store, fs.LocalFileSystem):
        spread(copies).mapInArrow(copied, "file string").collect()
    else:
        parts = F.sort_array(F.collect_list(F.struct("begin", "part"))).alias("parts")
        spread(copies.groupBy("file").agg(parts)).mapInArrow(streamed, "file string").collect()


def _copy(path: str, out) -> None:
    store, name = locate(path)
    with store.open_input_stream(name, compression=None) as file:
        while piece := file.read(PIECE):
            out.write(piece)


def write_tar_csv(
    df: DataFrame, path: str, parts: int, *, rows_per_member: int = 100_000, compression: str | None = None
) -> None:
    """Text rows as CSV members of tar archives, plain or ``gz``; one archive to a task.

    Tasks write below ``_parts``, which listings leave out, under names of their own;
    those of the tasks that count are moved up in the end.
    """
    names, ending = df.columns, f"tar.{compression}" if compression else "tar"
    top = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{uuid.uuid4().hex}.{ending}"
        store, folder = locate(f"{top}/_parts")
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            with tarfile.open(fileobj=out, mode=f"w|{compression or ''}") as tar:
                for number, member in enumerate(_csv_members(batches, names, rows_per_member)):
                    info = tarfile.TarInfo(f"{number:06}.csv")
                    info.size = len(member)
                    tar.addfile(info, io.BytesIO(member))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    text = df.select(*[F.col(f"`{c}`").cast("string") for c in names]).repartition(parts)
    done = [r["name"] for r in text.mapInArrow(run, "name string").collect()]
    store, folder = locate(top)
    for name in done:
        store.move(f"{folder}/_parts/{name}", f"{folder}/{name}")
    store.delete_dir(f"{folder}/_parts")


def _csv_members(batches: Iterator[pa.RecordBatch], names: list[str], size: int) -> Iterator[bytes]:
    out, rows = None, 0
    for batch in batches:
        for record in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None:
                out = io.StringIO()
                writer = csv.writer(out, lineterminator="\n")
                writer.writerow(names)
            writer.writerow(record)
            rows += 1
            if rows == size:
                yield out.getvalue().encode()
                out, rows = None, 0
    if out is not None:
        yield out.getvalue().encode()


def write_orders_silver(df: DataFrame, path: str) -> None:
    """Order fact as Parquet by event date (SNK2).

    Rows are gathered by date; adaptive execution splits the larger dates and joins
    small ones by size, so a busy day is not one task and a task does not open a
    file for every date.
    """
    (
        df.hint("rebalance", "event_date_brt")
        .write.mode("overwrite")
        .partitionBy("event_date_brt")
        .parquet(path)
    )


def write_users_silver(df: DataFrame, path: str) -> None:
    """User table as Parquet (SNK3)."""
    df.write.mode("overwrite").parquet(path)


def save_table_csv(
    df: DataFrame, outdir: str, name: str, sort_by: Sequence[str] = ()
) -> str:
    """A result table as one CSV file with header (SNK4).

    For finished tables of a few rows. The rows are moved to one task after they
    are computed, so the computation itself keeps its tasks.
    """
    path = f"{outdir.rstrip('/')}/{name}"
    one = df.repartition(1)
    if sort_by:
        one = one.sortWithinPartitions(*sort_by)
    one.write.mode("overwrite").option("header", True).csv(path)
    return path


def stack_segment_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of several segmentations as one, told apart by ``segment_name`` (RSH5)."""
    stacked = None
    for name, table in tables.items():
        part = table.withColumns(
            {"segment_name": F.lit(name), "segment": F.col("segment").cast("string")}
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no tables given")
    return stacked


def save_segment_tables(tables: Mapping[str, DataFrame], path: str) -> str:
    """One CSV folder per segmentation (SNK5)."""
    (
        stack_segment_tables(tables)
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy("segment_name")
        .csv(path)
    )
    return path
