"""User samples and tail clipping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns, with_user_metrics
from ..functions.fixed_values import SAMPLE_COLUMNS, SAMPLE_EXTRA_COLUMNS
from ..functions.sampling import in_sample, sample_hash
from .order_stats import N_BUCKETS, pick_ranks, quantile_struct, quantile_table, value_runs

CLIP_METRICS = ("monetary", "frequency", "aov_user")


def user_level_for_tests(
    users: DataFrame,
    *,
    required_cols: Iterable[str] = (),
    sample_frac: float | None = 0.25,
    seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """User columns for tests, optionally a hash sample of the users (SRT4, SRT6).

    The sample is a filter on a hash of the id: no shuffle, and an equal share
    of every arm, so stratified and plain samples coincide. Stratifying leaves
    out users without an arm.
    """
    required = list(required_cols)
    require_columns(users, [*SAMPLE_COLUMNS, *required], "user table")
    wanted = [*SAMPLE_COLUMNS, *SAMPLE_EXTRA_COLUMNS, *required]
    keep = [c for c in dict.fromkeys(wanted) if c in users.columns]
    df = users.select(*keep)
    if sample_frac is not None and 0 < sample_frac < 1:
        df = df.where(in_sample("customer_id", sample_frac, seed))
        if stratify:
            df = df.where(F.col("is_target").isNotNull())
    metrics = with_user_metrics(df)
    order = [*SAMPLE_COLUMNS, "aov_user", "conv_flag"]
    return metrics.select(*order, *[c for c in keep if c not in order])


def cap_rows(
    df: DataFrame, max_rows: int, *, id_col: str = "customer_id", seed: int = 42,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """The ``max_rows`` rows with the smallest sample hash, ties by id (SRT5).

    The limit is the feature here. Sorting with a limit would send that many
    rows of every partition to one task; instead the hash of the last row to
    keep is found by rank, rows below it pass a filter, and only rows that share
    that very hash are numbered.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    hashed = df.withColumn("_h", sample_hash(id_col, seed))
    ranked = pick_ranks(value_runs(hashed, ["_h"], n_buckets=n_buckets), [str(max_rows)])
    last = ranked.agg(F.max("r0")).scalar().cast("bigint")
    kept = hashed.withColumn("_last", F.coalesce(last, F.lit(2**32))).where("_h <= _last")
    place = Window.partitionBy("_h").orderBy(id_col)
    below = hashed.where(F.col("_h") < F.coalesce(last, F.lit(2**32))).agg(F.count("*")).scalar()
    return (
        kept.withColumn("_place", F.row_number().over(place))
        .where((F.col("_h") < F.col("_last")) | (F.col("_place") <= F.lit(max_rows) - below))
        .drop("_h", "_last", "_place")
    )


def clip(value: Column, low: Column, high: Column) -> Column:
    """Value moved into [low, high]; NULL stays NULL, missing bounds leave it alone."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def winsorize(
    users: DataFrame,
    *,
    p: float = 0.01,
    metrics: Sequence[str] = CLIP_METRICS,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Clip each metric to its p and 1-p quantiles over all users (ST7).

    Quantiles interpolate. The bounds are one scalar subquery, so no row moves.
    """
    bounds = quantile_struct(
        users, list(metrics), [p, 1 - p], method="cont", n_buckets=n_buckets
    )
    return users.withColumns(
        {m: clip(F.col(m).cast("double"), bounds[m][0], bounds[m][1]) for m in metrics}
    )


def winsorize_by_group(
    users: DataFrame,
    *,
    p: float = 0.01,
    metrics: Sequence[str] = CLIP_METRICS,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Clip each metric to the quantiles of its own arm, 0 or 1 (ST7).

    Users of another or no arm are left out. With two arms the bounds are at
    most two rows per metric, which is what makes the broadcast safe.
    """
    arms = users.where(F.col("is_target").isin(0, 1))
    table = quantile_table(
        arms, list(metrics), [p, 1 - p], ["is_target"], method="cont", n_buckets=n_buckets
    )
    bounds = table.groupBy("is_target").agg(
        *[
            F.max(F.when(F.col("metric") == m, F.struct("q0", "q1"))).alias(f"_bounds_{m}")
            for m in metrics
        ]
    )
    clipped = arms.join(F.broadcast(bounds), "is_target", "left").withColumns(
        {
            m: clip(F.col(m).cast("double"), F.col(f"_bounds_{m}.q0"), F.col(f"_bounds_{m}.q1"))
            for m in metrics
        }
    )
    return clipped.drop(*[f"_bounds_{m}" for m in metrics])
