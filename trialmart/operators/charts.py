"""The numbers behind box plots and histograms; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from .order_stats import (
    N_BUCKETS,
    attach_to_runs,
    pick_ranks,
    quantile_columns,
    quantiles_of_runs,
    rank_columns,
    value_runs,
)

_QUARTILES = (0.25, 0.5, 0.75)


def _arm_runs(
    users: DataFrame, metrics: Sequence[str], keys: Sequence[str], n_buckets: int
) -> DataFrame:
    """Value runs per key, arm and metric, for the arms 0 and 1."""
    require_columns(users, [*keys, *metrics, "is_target"], "user table")
    arms = users.where(F.col("is_target").isin(0, 1))
    return value_runs(arms, metrics, [*keys, "is_target"], n_buckets=n_buckets)


def _tails(clip_p: float | None) -> tuple[float, ...]:
    return (clip_p, 1 - clip_p) if clip_p is not None and 0 < clip_p < 0.5 else ()


_CLIPPED = "if({value} is not null, least(greatest({value}, lo), hi), null)"


def _boxes(runs: DataFrame, tails: Sequence[float]) -> DataFrame:
    """Clip bounds, quartiles and fences per cell from one ranking.

    Clipping keeps the order of values, so quartiles of the clipped metric come
    from the clipped values at the same ranks.
    """
    probs = (*tails, *_QUARTILES)
    none = ["cast(null as double)"] * 2
    low, high = quantile_columns(probs, "cont")[: len(tails)] or none
    quartiles = quantile_columns(probs, "cont", _CLIPPED)[len(tails) :]
    return (
        pick_ranks(runs, rank_columns(probs, "cont"))
        .selectExpr("*", f"{low} as lo", f"{high} as hi")
        .selectExpr(
            "cell", "lo", "hi",
            *[f"{q} as {name}" for q, name in zip(quartiles, ("q1", "median", "q3"))],
        )
        .selectExpr("*", "q1 - 1.5D * (q3 - q1) as fence_lo", "q3 + 1.5D * (q3 - q1) as fence_hi")
    )


def boxplot_stats(
    users: DataFrame,
    metrics: Sequence[str],
    *,
    keys: Sequence[str] = (),
    clip_p: float | None = None,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Quartiles, whiskers and outlier counts per key, arm and metric (CH1, CH2).

    Whiskers end at the last values within 1.5 interquartile ranges of the box,
    but not inside the box. With ``clip_p`` each cell is clipped to its own tail
    quantiles first.
    """
    runs = _arm_runs(users, metrics, keys, n_buckets)
    full = attach_to_runs(runs, _boxes(runs, _tails(clip_p)))
    value, n = F.expr(_CLIPPED.format(value="value")), F.col("n")
    inside = value.between(F.col("fence_lo"), F.col("fence_hi"))
    per_cell = full.groupBy("cell", "q1", "median", "q3").agg(
        F.sum("n").alias("n"),
        F.min(F.when(inside, value)).alias("low"),
        F.max(F.when(inside, value)).alias("high"),
        F.sum(F.when(~inside, n).otherwise(0)).alias("n_outliers"),
    )
    return per_cell.select(
        "cell.*",
        "n",
        "q1",
        "median",
        "q3",
        F.least("low", "q1").alias("whisker_lo"),
        F.greatest("high", "q3").alias("whisker_hi"),
        "n_outliers",
    )


def density_histogram(
    users: DataFrame,
    metrics: Sequence[str],
    *,
    keys: Sequence[str] = (),
    bins: int = 50,
    clip_p: float | None = None,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Density histogram over each cell's own range (CH3, CH4).

    Columns: keys, ``is_target``, ``metric``, ``bin`` from 0, ``bin_lo``,
    ``bin_hi``, ``n``, ``density``; empty bins are absent. The last bin includes
    its upper edge. A cell with a single value gets a range of width 1 around it.
    """
    runs = _arm_runs(users, metrics, keys, n_buckets)
    tails = _tails(clip_p)
    if tails:
        # The smallest and largest values lie outside the bounds or on them, so
        # the bounds are the range of the clipped metric.
        span = quantiles_of_runs(runs, tails, "cont").select(
            "cell", "total", F.col("q0").alias("lo"), F.col("q1").alias("hi")
        )
    else:
        span = runs.groupBy("cell").agg(
            F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
    span = span.selectExpr(
        "cell", "total", "lo", "hi",
        "if(lo = hi, lo - 0.5D, lo) as first", "if(lo = hi, hi + 0.5D, hi) as last",
    )
    full = attach_to_runs(runs, span).withColumn("value", F.expr(_CLIPPED.format(value="value")))
    place = F.expr(f"cast(floor((value - first) * {bins} / (last - first)) as int)")
    binned = full.groupBy(
        "cell", "total", "first", "last", F.least(place, F.lit(bins - 1)).alias("bin")
    ).agg(F.sum("n").alias("n"))
    width = (F.col("last") - F.col("first")) / bins
    return binned.select(
        "cell.*",
        "bin",
        (F.col("first") + F.col("bin") * width).alias("bin_lo"),
        (F.col("first") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )
