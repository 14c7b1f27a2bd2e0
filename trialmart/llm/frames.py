"""Helpers around DataFrames that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nest(df: DataFrame, **named: str) -> DataFrame:
    """All columns as one struct ``row``, next to some of them under fixed names.

    Whatever the columns are called, they meet no helper columns; ``row.*`` undoes it.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(whole, *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def renamed(df: DataFrame) -> DataFrame:
    """The columns as ``_0``, ``_1`` and so on, which meet no helper columns; for ``named_as``."""
    return df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])


def named_as(df: DataFrame, model: DataFrame) -> DataFrame:
    """The columns that ``renamed`` made of those of ``model``, under their own names."""
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(model.columns)])


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def append_columns(
    df: DataFrame,
    input_col: str,
    ddl: str,
    make: Callable[[], Callable[[pa.Array], Sequence[Sequence]]],
) -> DataFrame:
    """``df`` with columns computed from one of its own, batch by batch.

    ``make`` runs once in each task and returns the function from a column to the
    new columns. Columns of the same names are replaced; all others pass
    unchanged, whatever their types. The input goes to the tasks' Python once.
    """
    new = schema_of(ddl)
    kept = [f for f in df.schema if f.name not in new.names]
    sent = [F.col(f"`{f.name}`") for f in kept]
    if input_col in new.names:
        sent.append(F.col(f"`{input_col}`").alias("_input"))
    at = next((i for i, f in enumerate(kept) if f.name == input_col), len(kept))
    width, arrow = len(kept), to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            values = compute(batch.column(at))
            arrays = batch.columns[:width] + [
                pa.array(v, type=f.type) for v, f in zip(values, arrow)
            ]
            names = batch.schema.names[:width] + arrow.names
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*sent).mapInArrow(run, T.StructType(kept + new.fields))


def rows_from_texts(
    df: DataFrame,
    columns: Sequence[str],
    ddl: str,
    make: Callable[[], Callable[[pa.RecordBatch | None], list[Sequence] | None]],
) -> DataFrame:
    """Rows of another shape from some columns; the function is called once more
    with None at the end of the task, for what it has summed up."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if (made := compute(batch)) is not None:
                yield _batch(made)
        if (made := compute(None)) is not None:
            yield _batch(made)

    def _batch(values) -> pa.RecordBatch:
        arrays = [pa.array(v, type=f.type) for v, f in zip(values, arrow)]
        return pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
