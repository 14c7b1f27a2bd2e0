"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    """Fail at plan time, naming every missing column (PRJ24)."""
    missing = sorted({n for n in names if n not in df.columns})
    if missing:
        raise KeyError(f"{what} lacks columns: {missing}")


def column_or_null(df: DataFrame, name: str, dtype: str, lower: bool = False) -> Column:
    """The column cast tolerantly to ``dtype``, or a typed NULL if absent (PRJ2)."""
    if name not in df.columns:
        return F.lit(None).cast(dtype)
    col = F.col(name)
    if lower:
        col = F.lower(col.cast("string"))
    return col.try_cast(dtype)


def not_negative(name: str) -> Column:
    return F.when(F.col(name) >= 0, F.col(name))


def within(col: Column, low: float, high: float) -> Column:
    return F.when(col.between(low, high), col)


def user_aov() -> Column:
    """Average order value of one user, NULL for a user without orders (PRJ22)."""
    return F.when(
        F.col("frequency") > 0, F.try_divide(F.col("monetary"), F.col("frequency"))
    ).cast("double")


def converted() -> Column:
    return F.col("frequency") > 0


def with_user_metrics(users: DataFrame) -> DataFrame:
    """Add ``aov_user`` and ``conv_flag`` to a user table (PRJ22)."""
    require_columns(users, ["customer_id", "is_target", "frequency", "monetary"], "user table")
    return users.withColumns(
        {"aov_user": user_aov(), "conv_flag": converted().cast("int")}
    )


def group_label(group: Column, names: dict[int, str]) -> Column:
    """Readable arm name, NULL for an arm that has none (PRJ23)."""
    label = F.lit(None).cast("string")
    for value, text in names.items():
        label = F.when(group == value, F.lit(text)).otherwise(label)
    return label


def count_ids(id_col: str, ids_unique: bool) -> Column:
    """Number of users: a plain count when the id is known to be a key.

    The plain count needs one small shuffle instead of the two of a distinct
    count, which has to move every id.
    """
    return F.count(id_col) if ids_unique else F.count_distinct(id_col)


def _sortable(df: DataFrame, name: str) -> Column:
    # Maps have no order in Spark; their JSON text does.
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.to_json(F.col(name))
    return F.col(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``, NULLs last (SRT1).

    Written as ``row_number() = 1`` so that Spark puts a group limit before the
    exchange: each map task sends at most one row per key, however many copies
    of a key there are.
    """
    by = Window.partitionBy(*keys).orderBy(*[_sortable(df, c).asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def splittable_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join of a large table with a keyed one where a key may own many rows.

    Adaptive execution splits a hot key only if both inputs come straight from a
    shuffle made for the join. An aggregate or a join on the same key would be
    taken as it is; wrapping the key in a struct makes Spark shuffle that side
    again, which costs little next to the large one. Small sides are broadcast
    as ever. As in any equi-join a NULL key matches nothing.
    """
    tagged = right.where(F.col(key).isNotNull()).withColumn("_key", F.struct(key)).drop(key)
    return left.withColumn("_key", F.struct(key)).join(tagged, "_key", how).drop("_key")


# Averages of amounts with few decimals often lie midway between two rounded
# values, where the last bit of a sum decides. The shift settles those upwards.
TIE_SHIFT = 1.234567e-8


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used where results are compared or shown."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") + TIE_SHIFT, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
