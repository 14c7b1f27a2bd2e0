"""Connected components of a link table.

Tasks turn what links they hold into stars first, some at a time; what is left is
joined. A table of few links is one star for each component after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import splittable_join
from ..sources.storage import stage

LINKS = 500_000  # that a task looks at together


def star_labels(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Vertices of the links in order, and the place of the smallest one of each one's component.

    ``x`` and ``y`` are the fields of the vertices.
    """
    fields = [np.concatenate(f) for f in zip(x, y)]
    order = np.lexsort(fields[::-1])
    fields = [f[order] for f in fields]
    new = np.ones(len(order), bool)
    new[1:] = np.any([f[1:] != f[:-1] for f in fields], axis=0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    label = np.arange(int(new.sum()))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while not np.array_equal(label, further := label[label]):
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return [f[new] for f in fields], label


def stars(links: DataFrame, n: int) -> DataFrame:
    """``(vertex, label)``: the ``n`` links as stars of the same components, each task's own."""
    kind = links.schema[0].dataType
    schema = T.StructType([T.StructField("vertex", kind), T.StructField("label", kind)])
    arrow = to_arrow_schema(schema)

    def fields(column: pa.Array) -> list[np.ndarray]:
        return [np.asarray(f) for f in (column.flatten() if pa.types.is_struct(column.type) else [column])]

    def column(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        if not pa.types.is_struct(kind):
            return pa.array(values[0], kind)
        return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, kind)], fields=list(kind))

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in whole:
            vertices, label = star_labels(fields(batch.column(0)), fields(batch.column(1)))
            ends = [vertices, [f[label] for f in vertices]]
            yield pa.RecordBatch.from_arrays([column(e, f.type) for e, f in zip(ends, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LINKS:
                yield from made(held)
                held, size = [], 0
        if size:
            yield from made(held)

    return links.coalesce(max(1, -(-n // LINKS))).mapInArrow(run, schema)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(vertex, label)``: the smallest vertex of each component, linked vertices only.

    Vertices are whole numbers or structs of them, never null. Up to ``LINKS`` links are
    one task's. Of more, each task makes stars, and every round takes the smallest label
    among the neighbours and then the label of that label, so the rounds grow with the
    logarithm of the longest chain. Each is staged; only numbers reach the driver.
    """
    pairs = stage(links.select(F.col(a).alias("x"), F.col(b).alias("y")), "component_links")
    n = pairs.count()
    found = stage(stars(pairs, n), "component_labels")
    if n <= LINKS:
        return found
    ways = F.array(F.struct(F.col("vertex").alias("x"), F.col("label").alias("y")),
                   F.struct(F.col("label").alias("x"), F.col("vertex").alias("y")))
    both = stage(found.select(F.inline(ways)).distinct(), "component_links")
    first = both.groupBy(F.col("x").alias("vertex")).agg(F.least(F.min("y"), F.col("vertex")).alias("label"))
    labels = stage(first, "component_labels")
    while True:
        seen = splittable_join(
            both, labels.select(F.col("vertex").alias("y"), "label"), "y", "inner"
        )
        near = seen.groupBy(F.col("x").alias("vertex")).agg(F.min("label").alias("near"))
        moved = labels.withColumnRenamed("label", "old").join(near, "vertex").withColumn(
            "label", F.least("old", "near")
        )
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        jumped = splittable_join(moved, jump, "label", "left").withColumn(
            "label", F.coalesce("further", "label")
        )
        new = stage(jumped.select("vertex", "label", "old"), "component_labels")
        labels = new.select("vertex", "label")
        if new.where("label <> old").isEmpty():
            return labels
