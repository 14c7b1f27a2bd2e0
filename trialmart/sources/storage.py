"""Tables written to the shared folder to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder below the session's warehouse, which every
    executor can reach as well. Never a folder of one machine's own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return configured.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trialmart/{spark.sparkContext.applicationId}"


_MADE: ContextVar[list[str] | None] = ContextVar("folders made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder in the shared folder that nothing else uses."""
    path = f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The list of folders made inside, for ``drop_folders`` later on.

    Of nested calls the inner one has them; other threads are not seen.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def drop_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders; those that are gone already do no harm."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold for the queries started here."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage is cut for good, later scans read only the columns they use, and
    Spark knows the size of the table when it decides whether to broadcast it.
    What the write has shuffled is dropped with it. The table stays until ``drop_staged``.
    ``batch_rows`` bounds what goes to Python at once, for rows that are long.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    values = {_CLEANUP: "true"}
    if batch_rows is not None:
        values[_BATCH_ROWS] = str(batch_rows)
    with _settings(spark, **values):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, name: str | None = None) -> None:
    """Remove what this session has staged: all of it, or the tables of one name.

    DataFrames that still read them fail afterwards.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(top):
        return
    for entry in files.listStatus(top):
        if name is None or entry.getPath().getName().rpartition("-")[0] == name:
            files.delete(entry.getPath(), True)
