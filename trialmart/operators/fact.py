"""Order fact: experiment window, joins, assignment policy, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns, splittable_join
from ..functions.fixed_values import ORDERS_SILVER_COLUMNS
from ..functions.timestamps import as_bound, start_of_day, utc_date
from ..sources.storage import stage
from .order_stats import quantile_table


def infer_window(orders: DataFrame, method: str = "minmax") -> DataFrame:
    """One row ``(window_start, window_end)`` of dates, the end exclusive (AGG1, AGG2).

    ``minmax`` spans all events, ``quantile`` cuts both ends at 1%, exactly and
    without gathering the events in one task.
    """
    if method == "minmax":
        ends = orders.agg(
            utc_date(F.min("event_ts_utc")).alias("lo"),
            utc_date(F.max("event_ts_utc")).alias("hi"),
        )
    elif method == "quantile":
        # The cut points and the ranks read the events twice; their input may be
        # a whole chain of parsing and deduplication, so one narrow column is staged.
        seconds = stage(
            orders.select(F.floor(F.unix_micros("event_ts_utc") / 1_000_000).alias("t")), "event_seconds"
        )
        cuts = quantile_table(seconds, ["t"], [0.01, 0.99])
        # A plain aggregate over the one cut row keeps the empty case at one row.
        ends = cuts.agg(
            utc_date(F.timestamp_seconds(F.max("q0"))).alias("lo"),
            utc_date(F.timestamp_seconds(F.max("q1"))).alias("hi"),
        )
    else:
        raise ValueError(f"unknown window method {method!r}")
    return ends.select(
        F.col("lo").alias("window_start"), F.date_add("hi", 1).alias("window_end")
    )


def window_bounds(window: DataFrame) -> tuple[Column, Column]:
    """The inferred window as two timestamps backed by one scalar subquery."""
    row = window.select(
        F.struct(
            start_of_day("window_start").alias("lo"),
            start_of_day("window_end").alias("hi"),
        )
    ).scalar()
    return row["lo"], row["hi"]


def experiment_window(
    orders: DataFrame, start: str | Column | None = None, end: str | Column | None = None
) -> DataFrame:
    """Events in ``[start, end)``; a missing bound is open (FLT3, FLT5)."""
    lo, hi = as_bound(start), as_bound(end)
    if lo is not None:
        orders = orders.where(F.col("event_ts_utc") >= lo)
    if hi is not None:
        orders = orders.where(F.col("event_ts_utc") < hi)
    return orders


def prune_event_dates(
    silver: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """``experiment_window`` for a silver table stored by ``event_date_brt``.

    The extra date condition, a day wider on both sides than the time window,
    lets the scan skip whole partitions.
    """
    if start is not None:
        silver = silver.where(F.col("event_date_brt") >= F.date_sub(F.lit(start).cast("date"), 1))
    if end is not None:
        silver = silver.where(F.col("event_date_brt") <= F.date_add(F.lit(end).cast("date"), 1))
    return experiment_window(silver, start, end)


def customer_dimension(
    consumers: DataFrame, abmap: DataFrame, null_as_control: bool = False
) -> DataFrame:
    """Assignment and customer attributes, one row per customer.

    Both sides have one row per key, so this join cannot skew. Joining the order
    table once to the result, in place of twice to its parts, leaves a single
    join in which one customer may own a large share of rows.
    """
    how = "full" if null_as_control else "left"
    return abmap.join(consumers, "customer_id", how)


def assignment_policy(df: DataFrame, null_as_control: bool = False) -> DataFrame:
    """Drop unassigned rows, or count them as control (FLT4)."""
    if null_as_control:
        return df.withColumn("is_target", F.coalesce(F.col("is_target"), F.lit(0)))
    return df.where(F.col("is_target").isNotNull())


def join_fact(
    orders: DataFrame,
    consumers: DataFrame,
    restaurants: DataFrame,
    abmap: DataFrame,
    null_as_control: bool = False,
) -> DataFrame:
    """Orders with customer, merchant and assignment columns (JN1-JN4).

    No broadcast hint: the merchant table grows with the business, so Spark
    broadcasts it while its size allows and shuffles beyond, splitting hot and
    missing merchants.
    """
    people = customer_dimension(consumers, abmap, null_as_control)
    how = "left" if null_as_control else "inner"
    joined = splittable_join(orders, people, "customer_id", how)
    assigned = assignment_policy(joined, null_as_control)
    return splittable_join(assigned, restaurants, "merchant_id", "left")


def build_orders_silver(fact: DataFrame) -> DataFrame:
    """The standard order columns, those that exist (PRJ19)."""
    return fact.select(*[c for c in ORDERS_SILVER_COLUMNS if c in fact.columns])


def fill_categories(silver: DataFrame) -> DataFrame:
    """Category columns without NULLs, next to the originals (PRJ20)."""
    unknown = F.lit("unknown")
    active = F.when(F.col("active"), F.lit("true")).when(~F.col("active"), F.lit("false"))
    return silver.withColumns(
        {
            "origin_platform_clean": F.coalesce(F.col("origin_platform").cast("string"), unknown),
            "language_clean": F.coalesce(F.lower(F.col("language").cast("string")), unknown),
            "active_clean": F.coalesce(active, unknown),
        }
    )


def price_range_means(silver: DataFrame) -> DataFrame:
    """Order-weighted merchant means per price range, one aggregate (PRJ21)."""
    return silver.groupBy("price_range").agg(
        F.avg("minimum_order_value").alias("mov_mean"),
        F.avg("delivery_time").alias("delivery_mean"),
    )


def impute_by_price_range(silver: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Fill merchant figures by the mean of their price range (PRJ21, JN5).

    A row without a price range stays as it is. The join carries no hint: the
    means are a stored table, so Spark knows their size, broadcasts them when
    small, and the orders do not move. Without ``means`` they are computed and
    staged here.
    """
    require_columns(silver, ["price_range", "minimum_order_value", "delivery_time"], "orders")
    means = stage(price_range_means(silver), "price_range_means") if means is None else means
    return (
        splittable_join(silver, means, "price_range", "left")
        .withColumns(
            {
                "minimum_order_value_imputed": F.coalesce("minimum_order_value", "mov_mean"),
                "delivery_time_imputed": F.coalesce("delivery_time", "delivery_mean"),
            }
        )
        .drop("mov_mean", "delivery_mean")
    )


def enrich_orders_for_analysis(silver: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Filled categories and imputed merchant figures; originals stay (PRJ20-21)."""
    return impute_by_price_range(fill_categories(silver), means)
