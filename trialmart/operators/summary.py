"""Group and segment summaries: means, medians, tails, heavy-user rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    converted,
    count_ids,
    require_columns,
    user_aov,
    with_user_metrics,
)
from ..functions.fixed_values import HEAVY_THRESHOLD
from .order_stats import N_BUCKETS, SKETCH_ACCURACY, quantile_table

# metric column -> name used in result columns
ROBUST_METRICS = {"monetary": "gmv_user", "frequency": "pedidos_user", "aov_user": "aov_user"}
_ROBUST_PROBS = {"median": 0.5, "p95": 0.95}


def _means(ids_unique: bool) -> list[Column]:
    return [
        count_ids("customer_id", ids_unique).alias("usuarios"),
        F.avg("frequency").alias("pedidos_user"),
        F.avg("monetary").alias("gmv_user"),
        F.avg(converted().cast("double")).alias("conversao"),
        # Mean of the users' own averages, not total value over total orders.
        F.avg(user_aov()).alias("aov"),
    ]


def compute_ab_summary(users: DataFrame, *, ids_unique: bool = False) -> DataFrame:
    """Users, orders, value, conversion and order value per arm (AGG9).

    Pass ``ids_unique=True`` for a table with one row per customer.
    """
    require_columns(users, ["customer_id", "is_target", "frequency", "monetary"], "user table")
    return users.groupBy("is_target").agg(*_means(ids_unique)).orderBy("is_target")


def top_segments(
    users: DataFrame, segment_col: str, k: int, *, ids_unique: bool = False
) -> DataFrame:
    """The k segments with most users; equal counts rank by segment (SRT2)."""
    counts = users.groupBy(segment_col).agg(count_ids("customer_id", ids_unique).alias("n"))
    return _largest(counts, segment_col, k)


def _largest(counts: DataFrame, segment_col: str, k: int) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(segment_col).asc_nulls_last()).limit(k)


def ab_metrics_by_segment(
    users: DataFrame,
    *,
    segment_col: str,
    top_k_segments: int | None = None,
    ids_unique: bool = False,
) -> DataFrame:
    """The summary per segment and arm, optionally for the largest segments (AGG12, JN6).

    A NULL segment is a row of its own, but never among the largest.
    """
    table = users.groupBy(segment_col, "is_target").agg(*_means(ids_unique))
    if top_k_segments:
        if ids_unique:  # the counts of both arms add up
            counts = table.groupBy(segment_col).agg(F.sum("usuarios").alias("n"))
            top = _largest(counts, segment_col, top_k_segments)
        else:
            top = top_segments(users, segment_col, top_k_segments)
        table = table.join(top, segment_col, "left_semi")
    return table.orderBy(segment_col, "is_target")


def unpivot_segments(users: DataFrame, segment_cols: Sequence[str]) -> DataFrame:
    """One row per user and segmentation: ``segment_name``, ``segment``."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("segment_name"), F.col(c).cast("string").alias("segment"))
            for c in segment_cols
        ]
    )
    return users.select("*", F.inline(pairs))


def ab_metrics_by_segments(
    users: DataFrame, segment_cols: Sequence[str], *, ids_unique: bool = False
) -> DataFrame:
    """Several segmentations in one scan and one shuffle (SEG3)."""
    return (
        unpivot_segments(users, segment_cols)
        .groupBy("segment_name", "segment", "is_target")
        .agg(*_means(ids_unique))
        .orderBy("segment_name", "segment", "is_target")
    )


def _robust_counts(heavy_threshold: int, ids_unique: bool) -> list[Column]:
    heavy = F.count_if(F.coalesce(F.col("frequency"), F.lit(0)) >= heavy_threshold)
    return [
        count_ids("customer_id", ids_unique).alias("usuarios"),
        F.try_divide(heavy, F.count("customer_id")).alias("heavy_users_rate"),
    ]


def _robust(
    users: DataFrame,
    keys: Sequence[str],
    heavy_threshold: int,
    method: str,
    ids_unique: bool,
    n_buckets: int,
) -> DataFrame:
    require_columns(users, [*keys, "customer_id", "monetary", "frequency"], "user table")
    wide = users.withColumn("aov_user", user_aov()).select(
        *keys, "customer_id", *ROBUST_METRICS
    )
    counts = _robust_counts(heavy_threshold, ids_unique)
    names = [f"{stat}_{name}" for stat in _ROBUST_PROBS for name in ROBUST_METRICS.values()]
    if method == "approx":
        # Sketches merge like any other aggregate, so everything fits in one.
        sketches = [
            F.percentile_approx(m, p, SKETCH_ACCURACY).alias(f"{stat}_{name}")
            for stat, p in _ROBUST_PROBS.items()
            for m, name in ROBUST_METRICS.items()
        ]
        table = wide.groupBy(*keys).agg(*counts, *sketches)
    else:
        table = _with_quantiles(wide, keys, counts, method, n_buckets)
    return table.select(
        *keys, "usuarios", *names, "heavy_users_rate",
        F.lit(heavy_threshold).alias("heavy_threshold"),
    ).orderBy(*keys)


def _with_quantiles(
    wide: DataFrame, keys: Sequence[str], counts: list[Column], method: str, n_buckets: int
) -> DataFrame:
    found = quantile_table(
        wide, list(ROBUST_METRICS), list(_ROBUST_PROBS.values()), keys,
        method=method, n_buckets=n_buckets,
    )
    columns = {}
    for i, stat in enumerate(_ROBUST_PROBS):
        for metric, name in ROBUST_METRICS.items():
            # A discrete quantile is one of the values, so it keeps their type.
            dtype = wide.schema[metric].dataType if method == "disc" else "double"
            pick = F.when(F.col("metric") == metric, F.col(f"q{i}")).cast(dtype)
            columns[f"{stat}_{name}"] = pick
    blank = {"usuarios": "bigint", "heavy_users_rate": "double"}
    quantile_rows = found.select(
        *keys,
        *[F.lit(None).cast(t).alias(c) for c, t in blank.items()],
        *[c.alias(n) for n, c in columns.items()],
    )
    count_rows = wide.groupBy(*keys).agg(*counts)
    both = count_rows.unionByName(quantile_rows, allowMissingColumns=True)
    # A few rows per group by now; the union spares a join on keys that may be NULL.
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in [*blank, *columns]])


def compute_robust_metrics(
    users: DataFrame,
    *,
    heavy_threshold: int = HEAVY_THRESHOLD,
    method: str = "disc",
    ids_unique: bool = False,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Median and p95 of value, orders and order value per arm (AGG10, AGG11).

    ``method`` is ``disc`` (exact), ``cont`` (exact, interpolated) or ``approx``
    (sketch).
    """
    return _robust(users, ["is_target"], heavy_threshold, method, ids_unique, n_buckets)


def robust_metrics_by_segment(
    users: DataFrame,
    *,
    segment_col: str,
    heavy_threshold: int = HEAVY_THRESHOLD,
    method: str = "disc",
    ids_unique: bool = False,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """The same per segment and arm (AGG13); ``cont`` drops NULL segments (AGG14)."""
    require_columns(users, [segment_col, "is_target"], "user table")
    if method == "cont":
        users = users.where(F.col(segment_col).isNotNull())
    named = users.withColumn("segment", F.col(segment_col))
    return _robust(
        named, ["segment", "is_target"], heavy_threshold, method, ids_unique, n_buckets
    )


def group_means(users: DataFrame) -> DataFrame:
    """Mean of the three user metrics per arm (AGG15)."""
    with_aov = users if "aov_user" in users.columns else with_user_metrics(users)
    return (
        with_aov.groupBy("is_target")
        .agg(*[F.avg(m).alias(m) for m in ROBUST_METRICS])
        .orderBy("is_target")
    )
