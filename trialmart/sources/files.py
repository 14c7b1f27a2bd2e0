"""File listings and checks before anything is loaded.

Listings go through Spark, so they work on any file system it can read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    EXTRACTED_AB_DIR,
    ORDER_CANDIDATES,
    REQUIRED_FILES,
)
from .manifest import file_manifest


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``(path, name, size_bytes)`` of all files below a folder; empty if it is missing.

    Hidden files and macOS companions (names with a leading ``.`` or ``_``) are
    not listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        found = reader.load(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "path string, name string, size_bytes long")
    return found.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
    )


def list_valid_ab_csvs(
    spark: SparkSession, folder: str, min_bytes: int = 0
) -> DataFrame:
    """Assignment CSVs, largest first; ``min_bytes`` leaves small ones out (SRC7)."""
    return (
        list_files(spark, folder, "*.csv")
        .where(F.col("size_bytes") >= min_bytes)
        .orderBy(F.col("size_bytes").desc(), "path")
    )


def _checked(spark: SparkSession, path: str, whole: bool) -> Row:
    """The manifest row of one file; FileNotFoundError if there is none."""
    try:
        found = file_manifest(spark, path, whole=whole).first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        found = None
    if found is None:
        raise FileNotFoundError(path)
    return found


def count_lines(spark: SparkSession, path: str) -> int | None:
    """Lines of a (compressed) text file, read to its end; None if the file is broken (SRC9).

    A missing file or a failing job is an error.
    """
    found = _checked(spark, path, True)
    return found["lines"] if found["ok"] else None


def is_readable_text(spark: SparkSession, path: str, whole: bool = True) -> bool:
    """Whether a (compressed) text file can be read; all of it unless ``whole`` is off (SRC9)."""
    return _checked(spark, path, whole)["ok"]


def sniff_orders_format(spark: SparkSession, path: str) -> str:
    """``json_array``, ``ndjson_or_objects``, ``missing`` or ``error:…`` (SRC10)."""
    try:
        return _format_of(_checked(spark, path, False))
    except FileNotFoundError:
        return "missing"


def _format_of(found: Row) -> str:
    if not found["ok"] and found["first_char"] is None:
        return f"error:{found['problem']}"
    return "json_array" if found["first_char"] == "[" else "ndjson_or_objects"


def preflight(
    spark: SparkSession, raw_dir: str, strict: bool = True, min_bytes: int = 0
) -> DataFrame:
    """One row per required file: presence, size, readability, lines read, problem (SRC8).

    ``detail`` has the guessed format and other candidates for the orders, the first
    members of the archive, and the assignment CSVs that ``min_bytes`` leaves out. A
    last row reports on the extracted assignment CSVs. ``strict`` reads the files
    to their end and raises when there is any problem; otherwise their beginning
    has to do, and ``lines_read`` is NULL. Errors of the job itself are raised as such.
    The loop is over the four file names of the contract.
    """
    depth = _depth(spark, raw_dir)
    top = list_files(spark, raw_dir).where(F.regexp_count("path", F.lit("/")) == F.lit(depth))
    there = {r["name"] for r in top.where(F.col("name").isin(*ORDER_CANDIDATES)).collect()}
    found = {}
    try:
        wanted = "{" + ",".join(REQUIRED_FILES.values()) + "}"
        checked = file_manifest(spark, raw_dir, pattern=wanted, whole=strict)
        at_top = checked.where(F.regexp_count("path", F.lit("/")) == F.lit(depth))
        found = {r["name"]: r for r in at_top.collect()}
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows = []
    for key, name in REQUIRED_FILES.items():
        path, row = _join(raw_dir, name), found.get(name)
        problem, detail = None, None
        if row is None:
            problem = f"missing file: {key} -> {path}"
        else:
            kind = "archive" if name.endswith(".tar.gz") else "gzip"
            if not row["ok"]:
                problem = f"unreadable {kind}: {name} at byte {row['broken_at']}: {row['problem']}"
            if row["first_members"]:
                detail = "members: " + ", ".join(row["first_members"])
        if key == "orders":
            others = sorted(there - {name})
            form = "missing" if row is None else _format_of(row)
            detail = f"format: {form}; candidates: {', '.join(others) or 'none'}"
        known = row or {"size_bytes": 0, "ok": None, "lines": None}
        lines = known["lines"] if known["ok"] else None
        rows.append((key, path, row is not None, known["size_bytes"], known["ok"], lines, problem, detail))
    folder = _join(raw_dir, EXTRACTED_AB_DIR)
    sized = list_valid_ab_csvs(spark, folder).withColumn("in", F.col("size_bytes") >= min_bytes)
    counts = sized.agg(F.count_if("in").alias("n"), F.count_if(~F.col("in")).alias("out")).first()
    n_csv, out = counts["n"], counts["out"]
    problem = None if n_csv else f"no valid CSV in {folder}"
    detail = f"{out} files under {min_bytes} bytes are left out" if out else None
    rows.append(("ab_csv", folder, n_csv > 0, n_csv, None, None, problem, detail))
    problems = [r[6] for r in rows if r[6]]
    if strict and problems:
        raise RuntimeError("preflight failed:\n - " + "\n - ".join(problems))
    return spark.createDataFrame(
        rows,
        "key string, path string, exists boolean, size_bytes long, readable boolean, "
        "lines_read long, problem string, detail string",
    )


def _depth(spark: SparkSession, folder: str) -> int:
    """Slashes in the full path of a file that lies directly in the folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return full.makeQualified(hadoop).toString().count("/") + 1
