"""Readers of the raw inputs. All values arrive as text; the conform step types them.

Orders keep every column that the files have. Finding the names takes one pass over
the files, unless the caller lists the extra ones.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import splittable_join
from ..functions.fixed_values import (
    EXTRACTED_AB_DIR,
    RAW_ORDER_FIELDS,
    REQUIRED_FILES,
    SHARDED_ORDERS_DIR,
)
from . import gzip_index, json_arrays
from .archives import is_finished
from .byte_access import CHUNK_BYTES, locate, spread
from .files import _join, list_files, preflight, sniff_orders_format
from .storage import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def orders_schema(extra_fields: Sequence[str] = ()) -> T.StructType:
    """The known raw fields and some more, all as text; the conform step casts tolerantly.

    An ``items`` array arrives as its JSON text.
    """
    names = list(dict.fromkeys([*RAW_ORDER_FIELDS, *extra_fields]))
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_orders_json(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    json_array: bool = False,
    extra_fields: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    index_dir: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Orders from line-delimited JSON or from JSON arrays (SRC2, SRC3).

    Without ``extra_fields`` the names of all columns are looked up in the files;
    with it, exactly those are read next to the known ones and no pass is needed.
    Arrays are split over tasks, and so are the lines of one gzip file; ``index_dir`` keeps
    the index of gzip ones.
    """
    if json_array:
        found = json_arrays.array_elements(spark, path, index_dir=index_dir, chunk_bytes=chunk_bytes)
        if schema is None and extra_fields is None:
            found = stage(found, "order_elements")
            extra_fields = json_arrays.keys_of(found)
        row = F.from_json("value", schema or orders_schema(extra_fields or ()))
        return found.select(row.alias("row")).select("row.*")
    lines = None
    if isinstance(path, str) and path.endswith(".gz"):
        lines = gzip_index.read_lines(spark, path, index_dir=index_dir, chunk_bytes=chunk_bytes)
    if schema is None and extra_fields is None:
        found = _json(spark.read.option("primitivesAsString", True), path, lines).columns
        extra_fields = [c for c in found if c != "_corrupt_record"]
    return _json(spark.read.schema(schema or orders_schema(extra_fields or ())), path, lines)


def _json(reader: DataFrameReader, path: str | Sequence[str], lines: DataFrame | None) -> DataFrame:
    """What the reader makes of JSON files, or of their ``lines``; Python's reader takes no table of them."""
    if lines is None:
        return reader.json(path)
    text = F.when(F.col("offset") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    texts, spark = lines.select(text.alias("value")), lines.sparkSession
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(reader._jreader.json(getattr(texts._jdf, "as")(encoder)), spark)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with header; text columns unless a schema is given (SRC5, SRC6).

    A file whose header differs from the others' or from the schema is refused when
    it is read; columns are never matched by position alone.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path if isinstance(path, str) else list(path))


def csv_headers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, file_path, size, header)`` of every CSV file below ``path``; an empty file has null.

    Only the first record of each file is read, by one task.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", "_metadata.file_path", F.col("length").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{**r, "header": first_record(r["path"])} for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "path string, file_path string, size long, header array<string>"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return spread(files, 200).mapInArrow(run, ddl)


def first_record(path: str) -> list[str] | None:
    store, name = locate(path)
    with store.open_input_stream(name, compression="gzip" if path.endswith(".gz") else None) as file:
        text = io.TextIOWrapper(io.BufferedReader(file), encoding="utf-8-sig", newline="")
        for record in csv.reader(text):
            if record:
                return [c.strip() for c in record]
    return None


def header_report(headers: DataFrame) -> DataFrame:
    """``(path, missing, reordered)``: what each file lacks of the columns of all files.

    ``reordered``: the columns shared with the first file come in another order there.
    """
    headers = headers.where("header is not null")
    every = headers.select(F.explode("header").alias("name")).agg(F.collect_set("name")).scalar()
    model = headers.agg(F.min_by("header", "path")).scalar()
    told = headers.withColumns({"every": every, "model": model})
    shared = F.filter("model", lambda c: F.array_contains("header", c))
    own = F.filter("header", lambda c: F.array_contains("model", c))
    return told.select(
        "path", F.array_sort(F.array_except("every", "header")).alias("missing"), (shared != own).alias("reordered")
    )


def read_csv_by_name(
    spark: SparkSession, path: str, *, pattern: str | None = None, min_bytes: int = 0, multi_line: bool = False
) -> DataFrame:
    """CSV files whose headers may differ, as one table of text (SRC6).

    The header of each file is found once and goes to its rows; values are matched by
    name, never by position, and null where a file has no such column. Columns come in
    the order of the first file, then the others' by name. ``header_report`` tells
    which file lacks what. ``multi_line``: values may hold line breaks, and a file is one task.
    """
    headers = stage(csv_headers(spark, path, pattern).where(F.col("size") >= min_bytes), "csv_headers")
    headers = headers.where("header is not null")
    first = headers.orderBy("path").select("header").first()
    if first is None:
        raise FileNotFoundError(f"no valid CSV in {path}")
    every = headers.select(F.explode("header").alias("name")).distinct().orderBy("name").collect()
    names = list(dict.fromkeys([*first["header"], *(r["name"] for r in every)]))
    width = headers.agg(F.max(F.size("header"))).first()[0]
    reader = spark.read.schema(", ".join(f"_c{i} string" for i in range(width)))
    reader = reader.option("header", True).option("recursiveFileLookup", True).option("multiLine", multi_line)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    cells = reader.csv(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.array(*[f"_c{i}" for i in range(width)]).alias("cells")
    )
    places = F.array(*[F.array_position("header", n).cast("int") for n in names])
    joined = splittable_join(cells, headers.select("file_path", places.alias("places")), "file_path", "inner")
    return joined.select(
        *[
            F.when(F.col("places")[i] > 0, F.get("cells", F.col("places")[i] - 1)).alias(n)
            for i, n in enumerate(names)
        ]
    )


def read_abmap(spark: SparkSession, folder: str, min_bytes: int = 0, *, by_name: bool = False) -> DataFrame:
    """All assignment CSVs below a folder (SRC6); ``min_bytes`` leaves small files out.

    Files with another header than the others' are refused, or with ``by_name``
    matched by column name. Spark lists the folder itself, so no paths pass through here.
    """
    if list_files(spark, folder, "*.csv").isEmpty():
        raise FileNotFoundError(f"no valid CSV in {folder}")
    if by_name:
        return read_csv_by_name(spark, folder, pattern="*.csv", min_bytes=min_bytes)
    found = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    if min_bytes:
        found = found.where(F.col("_metadata.file_size") >= min_bytes).select(*found.columns)
    return found


def read_orders(
    spark: SparkSession,
    raw_dir: str,
    *,
    trust_foreign_shards: bool = False,
    extra_fields: Sequence[str] | None = None,
) -> DataFrame:
    """Orders from shards when there are any, else from the single file (SRC4).

    A shard folder counts only when its writer has finished it; shards made by other
    tools carry no mark, so the caller has to vouch for them.
    """
    shards = _join(raw_dir, SHARDED_ORDERS_DIR)
    if not list_files(spark, shards, "part-*").isEmpty():
        if not (trust_foreign_shards or is_finished(spark, shards)):
            raise RuntimeError(f"{shards} is unfinished: it has no _SUCCESS")
        return read_orders_json(spark, _join(shards, "part-*"), extra_fields=extra_fields)
    path = _join(raw_dir, REQUIRED_FILES["orders"])
    array = sniff_orders_format(spark, path) == "json_array"
    return read_orders_json(spark, path, json_array=array, extra_fields=extra_fields)


def load_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The four raw tables; fails when a required file is missing or broken (SRC1)."""
    preflight(spark, raw_dir, strict=True)
    return {
        "orders": read_orders(spark, raw_dir),
        "consumers": read_csv(spark, _join(raw_dir, REQUIRED_FILES["consumers"])),
        "restaurants": read_csv(spark, _join(raw_dir, REQUIRED_FILES["restaurants"])),
        "abmap": read_abmap(spark, _join(raw_dir, EXTRACTED_AB_DIR), by_name=True),
    }


def read_result_csv(
    spark: SparkSession, path: str, schema: T.StructType | str
) -> DataFrame:
    """A result table written earlier (SRC13)."""
    return read_csv(spark, path, schema)
