"""The order fact by day, where writing a day again replaces just that day (SNK2).

Every write goes to a folder of its own, ``commit=<name>/event_date_brt=<day>``. The list of
live files (``versions``) names the commit of each day and is published after the write,
so a writer that is lost midway changes nothing, and a reader never sees half a write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import versions

DAY = "event_date_brt"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_TRIES = 20


def replace_days(df: DataFrame, path: str, days: Sequence[str] = ()) -> int:
    """Write the days that ``df`` has rows of, each instead of what was there; the version.

    ``days`` (as text) are replaced as well, with nothing if there are no rows. Writers at
    the same time are put in line; of one day the last counts. Rows without a day are a day
    of their own.
    """
    spark, commit = df.sparkSession, uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/commit={commit}"
    df.hint("rebalance", DAY).write.partitionBy(DAY).parquet(folder)
    written = [n.partition("=")[2] for n in versions.folder_names(spark, folder) if n.startswith(f"{DAY}=")]
    for _ in range(_TRIES):
        number, content = versions.latest(spark, path)
        live = {d: c for d, c in content.get("live", {}).items() if d not in days}
        live |= dict.fromkeys(written, commit)
        try:
            versions.publish(spark, path, number + 1, {"live": live, "schema": df.schema.json()})
            return number + 1
        except versions.VersionTaken:
            continue
    raise RuntimeError(f"no place in line among the writers of {path}")


def read_days(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, version: int | None = None
) -> DataFrame:
    """The live rows, of the days in ``[start, end)`` if given; an earlier version if asked for.

    Only the folders of these days are listed.
    """
    content = versions.latest(spark, path)[1] if version is None else versions.read(spark, path, version)
    if not content:
        raise FileNotFoundError(f"nothing has been published in {path}")
    schema = StructType.fromJson(json.loads(content["schema"]))
    top = path.rstrip("/")
    bounded = start is not None or end is not None
    wanted = [
        f"{top}/commit={c}/{DAY}={d}" for d, c in sorted(content["live"].items())
        if not (bounded and d == _NO_DAY) and (start is None or d >= start) and (end is None or d < end)
    ]
    if not wanted:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", top).parquet(*wanted)
    return found.select(*schema.names)


def drop_replaced(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove commits that none of the last ``keep`` versions names; their names.

    Not to be run while another writer is at work, whose commit is in no list yet.
    """
    last, _ = versions.latest(spark, path)
    live = {
        c for n in range(max(1, last - keep + 1), last + 1)
        for c in versions.read(spark, path, n).get("live", {}).values()
    }
    top = path.rstrip("/")
    names = [n for n in versions.folder_names(spark, top) if n.startswith("commit=")]
    gone = [n for n in names if n.partition("=")[2] not in live]
    for name in gone:
        versions.remove(spark, f"{top}/{name}")
    return gone
