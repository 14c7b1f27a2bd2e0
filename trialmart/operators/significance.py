"""Significance tests over all users.

Everything comes from sufficient statistics computed by Spark; p-values are
added to the finished rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns, with_user_metrics
from ..functions.pvalues import exact_u_pvalues, t_pvalue, z_pvalue
from .order_stats import N_BUCKETS, value_runs

# metric column -> name of the test row
TEST_METRICS = {"monetary": "gmv_user", "frequency": "pedidos_user", "aov_user": "aov"}
# The exact rank test is for samples without ties of which one is no larger than this,
# as far as U has no more than so many values.
EXACT_MOST = 8
EXACT_VALUES = 1 << 25
RANK_METRICS = {"monetary": "gmv_user_mw", "frequency": "pedidos_user_mw",
                "aov_user": "aov_user_mw"}


def _named(metric: Column, names: dict[str, str]) -> Column:
    label = metric
    for key, name in names.items():
        label = F.when(metric == key, F.lit(name)).otherwise(label)
    return label


def _metric_moments(users: DataFrame, metrics: Sequence[str], group_col: str) -> DataFrame:
    """One row per metric with size, mean and variance of both arms."""
    slim = users.where(F.col(group_col).isin(0, 1)).select(
        group_col, *[F.col(m).cast("double").alias(m) for m in metrics]
    )
    per_arm = (
        slim.unpivot([group_col], list(metrics), "metric", "value")
        .groupBy("metric", group_col)
        .agg(
            F.count("*").alias("rows"),
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.var_samp("value").alias("var"),
        )
    )
    sides = {"treat": 1, "ctrl": 0}
    return per_arm.groupBy("metric").agg(
        *[
            F.max(F.when(F.col(group_col) == arm, F.col(c))).alias(f"{c}_{side}")
            for side, arm in sides.items()
            for c in ("rows", "n", "mean", "var")
        ]
    )


def _welch(moments: DataFrame) -> DataFrame:
    """t and Welch-Satterthwaite degrees of freedom from the moments."""
    share = {s: F.try_divide(F.col(f"var_{s}"), F.col(f"n_{s}")) for s in ("treat", "ctrl")}
    spread = share["treat"] + share["ctrl"]
    t = F.try_divide(F.col("mean_treat") - F.col("mean_ctrl"), F.sqrt(spread))
    weights = [
        F.try_divide(share[s] * share[s], F.col(f"n_{s}") - 1) for s in ("treat", "ctrl")
    ]
    weight = weights[0] + weights[1]
    return moments.withColumns({"t": t, "df": F.try_divide(spread * spread, weight)})


def welch_ttest(
    users: DataFrame,
    *,
    metrics: Sequence[str] = ("monetary",),
    group_col: str = "is_target",
) -> DataFrame:
    """Two-sided Welch test of treatment against control, NULLs left out (ST1)."""
    require_columns(users, [*metrics, group_col], "user table")
    return _welch(_metric_moments(users, metrics, group_col)).select(
        "metric",
        F.col("n_treat"),
        F.col("n_ctrl"),
        "mean_treat",
        "mean_ctrl",
        "t",
        "df",
        t_pvalue("t", "df").alias("pval"),
    )


def _proportion_z(p1: Column, p2: Column, n1: Column, n2: Column) -> Column:
    pooled = F.try_divide(p1 * n1 + p2 * n2, n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    # No variation, no test: NULL, as with conversion when everybody converted.
    return F.when(error > 0, (p1 - p2) / error)


def ztest_proportions(
    users: DataFrame, *, flag_col: str = "conv_flag", group_col: str = "is_target"
) -> DataFrame:
    """Pooled two-proportion z test of a 0/1 column (ST3)."""
    moments = _metric_moments(users, [flag_col], group_col)
    sized = moments.withColumn(
        "z",
        _proportion_z(
            F.col("mean_treat"), F.col("mean_ctrl"), F.col("rows_treat"), F.col("rows_ctrl")
        ),
    )
    return sized.select(
        "metric",
        F.col("rows_treat").alias("n_treat"),
        F.col("rows_ctrl").alias("n_ctrl"),
        F.col("mean_treat").alias("p_treat"),
        F.col("mean_ctrl").alias("p_ctrl"),
        "z",
        z_pvalue("z").alias("pval"),
    )


def run_ab_tests(users: DataFrame) -> DataFrame:
    """Welch on value, orders and order value, z on conversion, in one scan (ST4)."""
    base = with_user_metrics(users)
    moments = _welch(_metric_moments(base, [*TEST_METRICS, "conv_flag"], "is_target"))
    is_flag = F.col("metric") == "conv_flag"
    z = _proportion_z(
        F.col("mean_treat"), F.col("mean_ctrl"), F.col("rows_treat"), F.col("rows_ctrl")
    )
    table = moments.select(
        _named(F.col("metric"), {**TEST_METRICS, "conv_flag": "conversao"}).alias("metric"),
        F.when(is_flag, F.lit("z")).otherwise(F.lit("welch")).alias("method"),
        F.when(is_flag, F.col("rows_treat")).otherwise(F.col("n_treat")).alias("n_treat"),
        F.when(is_flag, F.col("rows_ctrl")).otherwise(F.col("n_ctrl")).alias("n_ctrl"),
        F.when(~is_flag, F.col("t")).alias("t"),
        F.when(is_flag, z).alias("z"),
        F.when(~is_flag, F.col("df")).alias("df"),
    )
    return table.withColumn("pval", F.coalesce(t_pvalue("t", "df"), z_pvalue("z")))


def mann_whitney(
    users: DataFrame,
    *,
    metrics: Sequence[str] = ("monetary",),
    keys: Sequence[str] = (),
    group_col: str = "is_target",
    n_buckets: int = N_BUCKETS,
    method: str = "asymptotic",
) -> DataFrame:
    """Two-sided Mann-Whitney U of treatment against control per key and metric (ST2).

    Equal values are folded first. U splits into a part inside each bucket of
    values and a part between buckets; only the bucket sums meet in one task:

        U = sum over buckets (U inside + n_treat * controls in lower buckets)

    The p-value uses the normal approximation with tie and continuity
    correction. With ``method="auto"`` it is the exact one where one side has at
    most ``EXACT_MOST`` values and no value is there twice (and U can take at
    most ``EXACT_VALUES`` values); the column ``method`` says which. A side without
    values gives NULL statistics; when all values are equal nothing can differ, so p
    is 1 and z NULL.
    """
    if method not in ("asymptotic", "auto"):
        raise ValueError(f"unknown method: {method}")
    require_columns(users, [*keys, *metrics, group_col], "user table")
    runs = value_runs(users, metrics, keys, group_col=group_col, n_buckets=n_buckets)
    in_bucket = (
        Window.partitionBy("cell", "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = F.coalesce(F.sum("n_ctrl").over(in_bucket), F.lit(0))
    ties = (F.col("n_treat") + F.col("n_ctrl")).cast("double")
    local = runs.withColumns(
        {
            # As doubles: products of two counts outgrow a long.
            "wins": F.col("n_treat") * (lower + F.col("n_ctrl") / 2.0),
            "ties": ties * ties * ties - ties,
        }
    )
    sums = local.groupBy("cell", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("wins", "ties", "n_treat", "n_ctrl")]
    )
    earlier = (
        Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    between = F.col("n_treat") * F.coalesce(F.sum("n_ctrl").over(earlier), F.lit(0)).cast("double")
    totals = (
        sums.withColumn("between", between)
        .groupBy("cell")
        .agg(
            F.sum(F.col("wins") + F.col("between")).alias("u_raw"),
            F.sum("ties").alias("ties"),
            F.sum("n_treat").alias("n_treat"),
            F.sum("n_ctrl").alias("n_ctrl"),
        )
    )
    pairs = F.col("n_treat").cast("double") * F.col("n_ctrl")
    n = (F.col("n_treat") + F.col("n_ctrl")).cast("double")
    variance = pairs / 12.0 * ((n + 1.0) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1.0)), F.lit(0.0)))
    both = (F.col("n_treat") > 0) & (F.col("n_ctrl") > 0)
    larger = F.greatest(F.col("U"), pairs - F.col("U"))
    normal = F.when(both & ((variance <= 0) | (F.col("z") < 0)), F.lit(1.0)).otherwise(z_pvalue("z"))
    table = totals.withColumn("U", F.when(both, F.col("u_raw"))).withColumn(
        "z", F.try_divide(larger - pairs / 2.0 - 0.5, F.sqrt(F.when(variance > 0, variance)))
    )
    pval, label = normal, F.lit("asymptotic")
    if method == "auto":
        small = (F.least("n_treat", "n_ctrl") <= EXACT_MOST) & (pairs <= EXACT_VALUES)
        exact = both & (F.col("ties") == 0) & small
        # The function sees U only where the exact form applies.
        counted = exact_u_pvalues(F.when(exact, F.col("U")), "n_treat", "n_ctrl")
        table = table.withColumn("exact", counted)
        pval, label = F.coalesce("exact", normal), F.when(F.col("exact").isNotNull(), "exact").otherwise(label)
    return table.select(
        "cell.*", "n_treat", "n_ctrl", "U", "z", pval.alias("pval"), F.when(both, label).alias("method")
    )


def run_nonparam_tests(
    users: DataFrame, *, n_buckets: int = N_BUCKETS, method: str = "asymptotic"
) -> DataFrame:
    """Mann-Whitney on value, orders and order value (ST5)."""
    base = with_user_metrics(users)
    table = mann_whitney(base, metrics=list(RANK_METRICS), n_buckets=n_buckets, method=method)
    return table.withColumn("metric", _named(F.col("metric"), RANK_METRICS))


def nonparam_tests_by_segment(
    users: DataFrame, *, segment_col: str, n_buckets: int = N_BUCKETS, method: str = "asymptotic"
) -> DataFrame:
    """The same for every value of a segment column; NULL segments are left out (ST6)."""
    require_columns(users, [segment_col], "user table")
    base = with_user_metrics(users).withColumn("segment", F.col(segment_col))
    base = base.where(F.col("segment").isNotNull())
    table = mann_whitney(
        base, metrics=list(RANK_METRICS), keys=["segment"], n_buckets=n_buckets, method=method
    )
    return table.withColumn("metric", _named(F.col("metric"), RANK_METRICS))
