"""Result tables in the shapes charts need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import group_label, require_columns
from ..functions.fixed_values import GROUP_NAMES

BAR_METRICS = ("gmv_user", "pedidos_user", "aov")
_ROBUST_SOURCE = {"gmv_user": "gmv_user", "pedidos_user": "pedidos_user", "aov": "aov_user"}


def heavy_rate_pivot(robust: DataFrame, *, rate_col: str = "heavy_users_rate") -> DataFrame:
    """Heavy-user rate with one row per segment and one column per arm (RSH1)."""
    pivot = robust.groupBy("segment").pivot("is_target", [0, 1]).agg(F.first(rate_col))
    names = {str(arm): name for arm, name in GROUP_NAMES.items()}
    return pivot.withColumnsRenamed(names).orderBy("segment")


def prepare_bars_from_robust(
    robust: DataFrame, segment_col: str = "segment", which: str = "median"
) -> DataFrame:
    """Median or p95 columns under the names bar charts use (RSH2)."""
    which = which.lower()
    if which not in ("median", "p95"):
        raise ValueError("which must be 'median' or 'p95'")
    source = {bar: f"{which}_{name}" for bar, name in _ROBUST_SOURCE.items()}
    require_columns(robust, [segment_col, "is_target", *source.values()], "robust table")
    return robust.select(
        segment_col, "is_target", *[F.col(c).alias(bar) for bar, c in source.items()]
    )


def group_bars_long(summary: DataFrame, metrics: Sequence[str] = BAR_METRICS) -> DataFrame:
    """One row per arm and metric, with the arm's name (RSH4, PRJ23)."""
    named = summary.select(
        "is_target",
        group_label(F.col("is_target"), GROUP_NAMES).alias("grupo"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return named.unpivot(["is_target", "grupo"], list(metrics), "metric", "value")


def segment_bars_long(
    table: DataFrame,
    segment_col: str,
    metrics: Sequence[str] = BAR_METRICS,
    group_col: str = "is_target",
) -> DataFrame:
    """One row per segment, arm and metric; an arm a segment lacks is NULL (RSH3).

    Works on a finished table, a row per segment and arm. The arms are spread to
    columns and back, which fills the gaps without joining segments to arms.
    """
    slim = table.where(F.col(group_col).isin(0, 1)).select(
        F.col(segment_col).cast("string").alias("segment"),
        group_col,
        F.map_from_arrays(
            F.array(*[F.lit(m) for m in metrics]),
            F.array(*[F.col(m).cast("double") for m in metrics]),
        ).alias("cells"),
    )
    arms = slim.groupBy("segment").agg(
        *[F.first(F.when(F.col(group_col) == a, F.col("cells")), ignorenulls=True).alias(f"a{a}")
          for a in GROUP_NAMES]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("is_target"),
                F.lit(name).alias("grupo"),
                F.lit(m).alias("metric"),
                F.col(f"a{a}")[F.lit(m)].alias("value"),
            )
            for a, name in GROUP_NAMES.items()
            for m in metrics
        ]
    )
    return arms.select("segment", F.inline(rows))
