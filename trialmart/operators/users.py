"""User table: one row per customer with RFM inputs and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.fixed_values import HEAVY_THRESHOLD, USER_COLUMNS
from ..functions.timestamps import as_bound, utc_date
from .fact import assignment_policy, customer_dimension, infer_window, window_bounds


def _edge_value(name: str, latest: bool) -> Column:
    """First or last non-NULL value of a user in order of (event time, order id)."""
    pick = F.max_by if latest else F.min_by
    moment = F.when(F.col(name).isNotNull(), F.struct("event_ts_utc", "order_id"))
    return pick(F.col(name), moment).alias(name)


def _order_totals() -> list[Column]:
    return [
        F.max("event_ts_utc").alias("last_order"),
        F.count("*").alias("frequency"),
        F.sum("order_total_amount").alias("monetary"),
        _edge_value("origin_platform", latest=True),
    ]


def _with_flags(
    users: DataFrame,
    reference: Column | None,
    start: Column | None,
    end: Column | None,
    heavy_threshold: int,
) -> DataFrame:
    """Recency, new-customer and heavy-user columns (AGG5, AGG7, AGG8)."""
    created = F.col("consumer_created_at")
    known = start is not None and end is not None
    return users.withColumns(
        {
            "recency": F.datediff(utc_date(reference), utc_date("last_order")),
            "is_new_customer": (created >= start) & (created < end) if known else F.lit(False),
            "heavy_user": F.col("frequency") >= F.lit(heavy_threshold),
        }
    ).select(*USER_COLUMNS)


def last_event(orders: DataFrame) -> Column:
    """Time of the latest event, as a scalar subquery (AGG6)."""
    return orders.agg(F.max("event_ts_utc")).scalar()


def _bounds(
    orders: DataFrame, start: str | Column | None, end: str | Column | None
) -> tuple[Column, Column]:
    """Given bounds, completed from the data where one is missing (AGG4)."""
    lo, hi = as_bound(start), as_bound(end)
    if lo is None or hi is None:
        data_lo, data_hi = window_bounds(infer_window(orders))
        lo = data_lo if lo is None else lo
        hi = data_hi if hi is None else hi
    return lo, hi


def _reference(orders: DataFrame, end: Column, recency_ref: str) -> Column:
    if recency_ref == "window_end":
        return end
    if recency_ref == "last_event":
        return last_event(orders)
    raise ValueError("recency_ref must be 'window_end' or 'last_event'")


def build_user_aggregates(
    orders_silver: DataFrame,
    start_utc: str | Column | None = None,
    end_utc: str | Column | None = None,
    *,
    recency_ref: str = "window_end",
    heavy_threshold: int = HEAVY_THRESHOLD,
) -> DataFrame:
    """User table from the order fact (AGG3-AGG8).

    One aggregation; its map side folds the orders of a customer before they
    are shuffled, however many that customer has.
    """
    require_columns(
        orders_silver,
        ["customer_id", "order_id", "event_ts_utc", "order_total_amount", "is_target",
         "consumer_created_at", "origin_platform", "active"],
        "order fact",
    )
    start, end = _bounds(orders_silver, start_utc, end_utc)
    totals = orders_silver.groupBy("customer_id").agg(
        *_order_totals(),
        _edge_value("is_target", latest=False),
        F.min("consumer_created_at").alias("consumer_created_at"),
        _edge_value("active", latest=False),
    )
    reference = _reference(orders_silver, end, recency_ref)
    return _with_flags(totals, reference, start, end, heavy_threshold)


def users_from_conformed(
    orders: DataFrame,
    consumers: DataFrame,
    abmap: DataFrame,
    start_utc: str | Column | None = None,
    end_utc: str | Column | None = None,
    *,
    null_as_control: bool = False,
    recency_ref: str = "window_end",
    heavy_threshold: int = HEAVY_THRESHOLD,
) -> DataFrame:
    """The same user table without building the order fact.

    Orders are folded to one row per customer first and meet the customer and
    assignment tables at that grain: the wide order-level join, its shuffle and
    its skew are gone, and merchants are never read. ``orders`` must be
    conformed and already cut to the experiment window.
    """
    totals = orders.groupBy("customer_id").agg(
        *_order_totals(), F.min("event_ts_utc").alias("first_order")
    )
    return users_from_totals(
        totals, consumers, abmap, start_utc, end_utc,
        null_as_control=null_as_control, recency_ref=recency_ref, heavy_threshold=heavy_threshold,
    )


def users_from_totals(
    totals: DataFrame,
    consumers: DataFrame,
    abmap: DataFrame,
    start_utc: str | Column | None = None,
    end_utc: str | Column | None = None,
    *,
    null_as_control: bool = False,
    recency_ref: str = "window_end",
    heavy_threshold: int = HEAVY_THRESHOLD,
) -> DataFrame:
    """The user table from the totals of each customer's orders."""
    people = customer_dimension(consumers, abmap, null_as_control)
    joined = assignment_policy(
        totals.join(people, "customer_id", "left" if null_as_control else "inner"),
        null_as_control,
    )
    start, end = as_bound(start_utc), as_bound(end_utc)
    if start is None or end is None:
        # The users know their own first and last events: no second order scan.
        window = joined.select(
            F.explode(F.array("first_order", "last_order")).alias("event_ts_utc")
        )
        data_start, data_end = window_bounds(infer_window(window))
        start = data_start if start is None else start
        end = data_end if end is None else end
    reference = end
    if recency_ref == "last_event":
        reference = joined.agg(F.max("last_order")).scalar()
    elif recency_ref != "window_end":
        raise ValueError("recency_ref must be 'window_end' or 'last_event'")
    return _with_flags(joined, reference, start, end, heavy_threshold)


def recency_from_last_event(users: DataFrame) -> DataFrame:
    """Replace recency by the days to the latest event of any user (AGG6)."""
    latest = users.agg(F.max("last_order")).scalar()
    return users.withColumn("recency", F.datediff(utc_date(latest), utc_date("last_order")))


def orders_per_customer(orders: DataFrame) -> DataFrame:
    """Number of orders of each customer (AGG18)."""
    return orders.groupBy("customer_id").agg(F.count("*").alias("n_orders"))


def period_days(users: DataFrame, fallback: int = 30) -> DataFrame:
    """Days between first and last ``last_order``, ``fallback`` when zero (AGG17)."""
    days = F.datediff(utc_date(F.max("last_order")), utc_date(F.min("last_order")))
    return users.agg(
        F.coalesce(F.nullif(days, F.lit(0)), F.lit(fallback)).alias("period_days")
    )
