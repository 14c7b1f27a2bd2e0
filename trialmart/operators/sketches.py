"""Stored sketches: quantiles and distinct users of any grouping, without the rows (AGG9, AGG10, AGG12-14, SRT2).

One pass writes a small sketch for every day, segment and arm. They merge, so medians
of a month or of all segments, and the users that groups share, come from the stored
table alone. Every result has a bound of its error next to it. The exact operators
(``summary``) stay the default.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns, user_aov
from ..functions.timestamps import utc_date
from .summary import ROBUST_METRICS

QUANTILE_SIZE = 2000
USER_BITS = 14


def rank_error(k: int) -> float:
    """Bound of the rank error of a quantile sketch of size ``k``, as a share, at 99% confidence.

    The fit published for these sketches.
    """
    return 2.296 / k**0.9021


def quantile_sketches(
    users: DataFrame,
    keys: Sequence[str] = ("is_target",),
    metrics: Sequence[str] = tuple(ROBUST_METRICS),
    *,
    k: int = QUANTILE_SIZE,
) -> DataFrame:
    """A sketch of each metric for every day of the last order and combination of keys.

    ``(day, keys, metric, k, n, sketch)``. NULL and NaN values are left out, a group of
    them alone has no row. The table to store.
    """
    require_columns(users, [*keys, "last_order", "monetary", "frequency"], "user table")
    wide = users.withColumn("aov_user", user_aov()).withColumn("day", utc_date("last_order"))
    values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = wide.select("day", *keys, F.inline(F.array(*values))).where("value is not null and not isnan(value)")
    return long.groupBy("day", *keys, "metric").agg(
        F.lit(k).alias("k"), F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def merge_quantiles(stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups: ``(keys, metric, k, n, sketch)``.

    ``k`` is the smallest of those merged, which sets the error.
    """
    return stored.groupBy(*keys, "metric").agg(
        F.min("k").alias("k"), F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantiles(merged: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """``merged`` with a column for each probability, and ``rank_error``, instead of the sketch.

    A quantile's rank among the values is off by no more than that share of ``n``.
    """
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in probs.items()}
    error = F.lit(2.296) / F.pow(F.col("k").cast("double"), F.lit(0.9021))
    return merged.withColumns({**found, "rank_error": error}).drop("sketch", "k")


def user_error(bits: int) -> float:
    """Relative error of a count of distinct users, at 95% confidence, beyond ``2 ** bits`` users."""
    return 2 / math.sqrt((1 << bits) - 1)


def user_sketches(
    rows: DataFrame, keys: Sequence[str], *, id_col: str = "customer_id", bits: int = USER_BITS
) -> DataFrame:
    """A sketch of the users in every group: ``(keys, bits, users)``. Rows may repeat users.

    Up to ``2 ** bits`` users it counts exactly. The table to store.
    """
    return rows.groupBy(*keys).agg(
        F.lit(bits).alias("bits"), F.theta_sketch_agg(F.col(id_col), F.lit(bits)).alias("users")
    )


def merge_users(stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The users of coarser groups, each once."""
    smallest = F.min("bits").alias("bits")
    return stored.groupBy(*keys).agg(smallest, F.theta_union_agg("users", F.lit(USER_BITS)).alias("users"))


def _error(count: Column) -> Column:
    size = F.pow(F.lit(2.0), F.col("bits").cast("double"))
    return F.when(count > size, count * 2.0 / F.sqrt(size - 1)).otherwise(0.0)


def distinct_users(merged: DataFrame) -> DataFrame:
    """``n_users`` and ``error``, the bound in users, instead of the sketch."""
    counted = merged.withColumn("n_users", F.theta_sketch_estimate("users"))
    return counted.withColumn("error", _error(F.col("n_users"))).drop("users", "bits")


def largest_groups(stored: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` groups with most users; equal counts by key. A NULL group ranks last among them."""
    counted = distinct_users(merge_users(stored, [key]))
    return counted.orderBy(F.col("n_users").desc(), F.col(key).asc_nulls_last()).limit(k)


def shared_users(stored: DataFrame, key: str, groups: Sequence) -> DataFrame:
    """Users that all of the given groups share: one row ``(n_groups, n_all, n_any, error)``.

    ``error`` bounds both numbers of users. ``n_groups`` counts the groups that exist; the
    users shared are those of these.
    """
    merged = merge_users(stored.where(F.col(key).isin(*groups)), [key])
    both = merged.agg(
        F.count("*").alias("n_groups"), F.min("bits").alias("bits"),
        F.theta_intersection_agg("users").alias("shared"),
        F.theta_union_agg("users", F.lit(USER_BITS)).alias("any"),
    )
    counted = both.withColumns(
        {"n_all": F.theta_sketch_estimate("shared"), "n_any": F.theta_sketch_estimate("any")}
    )
    return counted.withColumn("error", _error(F.col("n_any"))).drop("bits", "shared", "any")
