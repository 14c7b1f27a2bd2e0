"""The standard chains from raw tables to silver tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions.fixed_values import BUSINESS_TZ
from ..operators.conform import (
    FACT_ORDER_COLUMNS,
    USER_ORDER_COLUMNS,
    conform_abmap,
    conform_consumers,
    conform_orders,
    conform_restaurants,
)
from ..operators.fact import experiment_window, infer_window, join_fact, window_bounds
from ..operators.users import users_from_conformed
from ..sources.storage import stage


@dataclass(frozen=True)
class Raw:
    """The four raw inputs."""

    orders: DataFrame
    consumers: DataFrame
    restaurants: DataFrame
    abmap: DataFrame


def _choose_window(
    orders: DataFrame,
    start: str | Column | None,
    end: str | Column | None,
    auto_infer: bool,
    use_quantiles: bool,
) -> tuple[str | Column | None, str | Column | None]:
    """Given bounds win; without any, both are inferred unless that is off (FLT5)."""
    if start is None and end is None and auto_infer:
        return window_bounds(infer_window(orders, "quantile" if use_quantiles else "minmax"))
    return start, end


def clean_and_conform(
    orders: DataFrame,
    consumers: DataFrame,
    restaurants: DataFrame,
    abmap: DataFrame,
    *,
    business_tz: str = BUSINESS_TZ,
    treat_is_target_null_as_control: bool = False,
    experiment_start: str | Column | None = None,
    experiment_end: str | Column | None = None,
    auto_infer_window: bool = True,
    use_quantile_window: bool = False,
    cache_intermediates: bool | None = None,
    offset_aware: bool = False,
    silver_only: bool = False,
) -> DataFrame:
    """Raw tables to the joined order fact (JN4).

    An inferred window needs the conformed orders more than once, so they are
    written to the shared folder first; ``cache_intermediates`` forces or forbids
    that.
    ``silver_only`` keeps just the order columns of the silver table, before the
    deduplication moves them.
    """
    columns = FACT_ORDER_COLUMNS if silver_only else None
    typed = conform_orders(orders, business_tz, offset_aware=offset_aware, columns=columns)
    inferred = auto_infer_window and experiment_start is None and experiment_end is None
    if inferred if cache_intermediates is None else cache_intermediates:
        typed = stage(typed, "orders_conformed")
    start, end = _choose_window(
        typed, experiment_start, experiment_end, auto_infer_window, use_quantile_window
    )
    return join_fact(
        experiment_window(typed, start, end),
        conform_consumers(consumers),
        conform_restaurants(restaurants),
        conform_abmap(abmap),
        treat_is_target_null_as_control,
    )


def users_silver(
    raw: Raw,
    *,
    business_tz: str = BUSINESS_TZ,
    treat_is_target_null_as_control: bool = False,
    experiment_start: str | Column | None = None,
    experiment_end: str | Column | None = None,
    auto_infer_window: bool = True,
    use_quantile_window: bool = False,
    cache_intermediates: bool | None = None,
    recency_ref: str = "window_end",
    offset_aware: bool = False,
) -> DataFrame:
    """Raw tables straight to the user table, without the order fact."""
    typed = conform_orders(
        raw.orders, business_tz, offset_aware=offset_aware, columns=USER_ORDER_COLUMNS
    )
    inferred = auto_infer_window and experiment_start is None and experiment_end is None
    if inferred if cache_intermediates is None else cache_intermediates:
        typed = stage(typed, "orders_conformed")
    start, end = _choose_window(
        typed, experiment_start, experiment_end, auto_infer_window, use_quantile_window
    )
    return users_from_conformed(
        experiment_window(typed, start, end),
        conform_consumers(raw.consumers),
        conform_abmap(raw.abmap),
        start,
        end,
        null_as_control=treat_is_target_null_as_control,
        recency_ref=recency_ref,
    )
