"""What of a folder is live, as numbered lists that are published whole.

Data is written under names of its own first. Then one small JSON file with the next
number names what readers are to see; it is renamed into place, which fails when
another writer had that number. So a reader sees a list that was finished or none of it,
and what a lost job has left is in no list.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_FOLDER = "_versions"


class VersionTaken(RuntimeError):
    """Another writer has published this number."""


def _path(spark: SparkSession, text: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it is missing."""
    files, top = _files(spark, path), _path(spark, path)
    return [e.getPath().getName() for e in files.listStatus(top)] if files.exists(top) else []


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last list, ``(0, {})`` before the first."""
    numbers = [int(n[:-5]) for n in folder_names(spark, f"{path}/{_FOLDER}") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), read(spark, path, max(numbers))


def read(spark: SparkSession, path: str, number: int) -> dict:
    text = spark.read.option("wholetext", True).text(f"{path}/{_FOLDER}/{number:09}.json")
    return json.loads(text.first()[0])


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make ``content`` list ``number``; VersionTaken if there is one."""
    top = f"{path}/{_FOLDER}"
    files = _files(spark, path)
    draft = _path(spark, f"{top}/_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, f"{top}/{number:09}.json")), plain)
    except Py4JJavaError as failed:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(failed):
            raise VersionTaken(f"{path} has a version {number} already") from failed
        raise


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
