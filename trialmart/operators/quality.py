"""Data quality checks on raw and silver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.fixed_values import DUPLICATE_KEYS, NULL_CHECK_COLUMNS
from .conform import group_column, normalize_headers


def time_range(orders: DataFrame) -> DataFrame:
    """First and last event (DQ1)."""
    return orders.agg(
        F.min("event_ts_utc").alias("min_utc"), F.max("event_ts_utc").alias("max_utc")
    )


def ab_split(users: DataFrame) -> DataFrame:
    """Users per arm (DQ2)."""
    return users.groupBy("is_target").agg(F.count("*").alias("n_users")).orderBy("is_target")


def null_counts(df: DataFrame, columns: Sequence[str] | None = NULL_CHECK_COLUMNS) -> DataFrame:
    """NULLs per column as ``(column_name, n_nulls)``; ``None`` checks all (DQ3).

    One aggregate of as many counters as columns, turned into rows afterwards.
    """
    names = [c for c in (columns or df.columns) if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "n_nulls")


def duplicate_groups(
    orders: DataFrame, keys: Sequence[str] = DUPLICATE_KEYS, *, ids_unique: bool = False
) -> DataFrame:
    """Key combinations shared by several orders, with the number of orders (DQ4).

    NULLs in the keys count as equal. Order ids are counted, not gathered, so a
    huge group costs no more than its counter.
    """
    require_columns(orders, [*keys, "order_id"], "orders")
    orders_seen = F.count("order_id") if ids_unique else F.count_distinct("order_id")
    return orders.groupBy(*keys).agg(orders_seen.alias("n_orders")).where("n_orders > 1")


def duplicate_members(
    orders: DataFrame,
    keys: Sequence[str] = DUPLICATE_KEYS,
    *,
    ids_per_row: int = 1000,
    ids_unique: bool = False,
) -> DataFrame:
    """The duplicate groups with their order ids, in parts (DQ4).

    A group of up to ``ids_per_row`` orders is one row with all its ids. A larger
    one is spread over ``n_parts`` rows by a hash of the order id, so no task and
    no row holds the whole group, and no id is left out.
    """
    groups = duplicate_groups(orders, keys, ids_unique=ids_unique)
    ours = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_orders")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    members = orders.select(*keys, "order_id").join(ours, match).drop(*[f"_{k}" for k in keys])
    parts = F.ceil(F.col("n_orders") / ids_per_row).cast("int")
    split = members.withColumn("n_parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("order_id"), F.col("n_parts")).cast("int")
    )
    return split.groupBy(*keys, "n_orders", "n_parts", "part").agg(
        F.array_sort(F.collect_set("order_id")).alias("order_ids")
    )


def duplicate_total(groups: DataFrame) -> DataFrame:
    """Number of duplicate combinations (DQ4)."""
    return groups.agg(F.count("*").alias("n_combinations"))


def worst_duplicates(groups: DataFrame, k: int = 10) -> DataFrame:
    """The k combinations with most orders; ties by the keys (DQ4)."""
    ties = [F.col(c).asc_nulls_last() for c in groups.columns if c != "n_orders"]
    return groups.orderBy(F.col("n_orders").desc(), *ties).limit(k)


def check_post_etl(
    orders_silver: DataFrame,
    users_silver: DataFrame,
    *,
    light: bool = True,
    key_cols: Sequence[str] = NULL_CHECK_COLUMNS,
    check_semantic_dups: bool = True,
    ids_unique: bool = False,
) -> dict[str, DataFrame]:
    """All silver checks by name, each lazy (DQ1-DQ4), with previews of both tables.

    ``light`` counts NULLs in key columns only, else in all. ``worst_duplicate_members``
    lists the orders of the worst combinations.
    """
    checks = {
        "preview_orders": preview(orders_silver),
        "preview_users": preview(users_silver),
        "time_range": time_range(orders_silver),
        "ab_split": ab_split(users_silver),
        "null_counts": null_counts(orders_silver, key_cols if light else None),
    }
    if check_semantic_dups:
        groups = duplicate_groups(orders_silver, ids_unique=ids_unique)
        checks["duplicate_total"] = duplicate_total(groups)
        worst = worst_duplicates(groups)
        checks["worst_duplicates"] = worst
        members = duplicate_members(orders_silver, ids_unique=ids_unique)
        # A handful of rows on the right; NULL keys are equal here.
        same = F.struct(*DUPLICATE_KEYS)
        checks["worst_duplicate_members"] = members.withColumn("_key", same).join(
            worst.select(same.alias("_key")), "_key", "left_semi"
        ).drop("_key")
    return checks


def profile(df: DataFrame, table: str, time_col: str | None = None) -> DataFrame:
    """Rows and time span of a table (DQ5)."""
    moment = F.col(time_col).cast("string") if time_col and time_col in df.columns else F.lit(
        None
    ).cast("string")
    return df.agg(
        F.lit(table).alias("table_name"),
        F.count("*").alias("n_rows"),
        F.min(moment).alias("min_time"),
        F.max(moment).alias("max_time"),
    )


def profile_loaded(
    orders: DataFrame, consumers: DataFrame, restaurants: DataFrame, abmap: DataFrame
) -> DataFrame:
    """Profile of the four raw tables (DQ5)."""
    return (
        profile(orders, "orders", "order_created_at")
        .unionByName(profile(consumers, "consumers"))
        .unionByName(profile(restaurants, "restaurants"))
        .unionByName(profile(abmap, "abmap"))
    )


def raw_group_counts(abmap: DataFrame) -> DataFrame:
    """Rows per raw experiment label (DQ5)."""
    named = normalize_headers(abmap)
    label = F.col(group_column(named)).cast("string").alias("group_label")
    return named.groupBy(label).agg(F.count("*").alias("n_rows"))


def preview(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """The first rows of some columns (SRT7)."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    return df.select(*names).limit(n)

