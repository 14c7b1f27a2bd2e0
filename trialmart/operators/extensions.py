"""Rules that the experiment report states but its code never computed.

They are separate operators; none of them changes the results of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.fixed_values import (
    COUPON_COST,
    COUPON_COST_GRID,
    REDEMPTION_RATE,
    TAKE_RATE,
)
from ..functions.timestamps import as_bound, utc_date
from .fact import experiment_window
from .finance import (
    _break_even_columns,
    _economics,
    break_even_needed,
    treatment_vs_control,
)
from .significance import welch_ttest


def break_even_grid(
    users: DataFrame,
    *,
    coupon_costs: Sequence[float] = COUPON_COST_GRID,
    take_rate: float = TAKE_RATE,
    redemption_rate: float = REDEMPTION_RATE,
    segment_col: str | None = None,
    ids_unique: bool = False,
) -> DataFrame:
    """Break-even table for several coupon costs from one pass over the users (EXT1)."""
    break_even_needed(take_rate)
    by = [segment_col] if segment_col else []
    both = treatment_vs_control(users, by, ids_unique=ids_unique)
    costs = F.array(*[F.lit(float(c)) for c in coupon_costs])
    each = both.withColumn("segment", F.col(segment_col) if segment_col else F.lit("ALL"))
    each = each.withColumn("coupon_cost", F.explode(costs))
    money = _economics(each, take_rate, F.col("coupon_cost"), redemption_rate)
    needed = F.col("coupon_cost") * redemption_rate / take_rate
    return _break_even_columns(money, needed, ["coupon_cost"])


def three_way_status(gap: Column, profit: Column, margin: float = 2.0) -> Column:
    """``No limite`` near the break-even, else ``OK`` or ``NEG`` (EXT4)."""
    return (
        F.when(F.abs(gap) < margin, F.lit("No limite"))
        .when((gap >= 0) & (profit >= 0), F.lit("OK"))
        .otherwise(F.lit("NEG"))
    )


def break_even_status3(table: DataFrame, margin: float = 2.0) -> DataFrame:
    """A break-even table with the three-way status of the report (EXT4)."""
    status = three_way_status(F.col("gap_uplift"), F.col("lucro_total"), margin)
    return table.withColumn("status", status)


def weekly_users(orders_silver: DataFrame) -> DataFrame:
    """Value per customer and week of the event, with arm and last platform."""
    moment = F.struct("event_ts_utc", "order_id")
    return orders_silver.groupBy(
        F.trunc(utc_date("event_ts_utc"), "week").alias("week"), "customer_id"
    ).agg(
        F.sum("order_total_amount").alias("monetary"),
        F.max("is_target").alias("is_target"),
        F.max_by("origin_platform", F.when(F.col("origin_platform").isNotNull(), moment)).alias(
            "origin_platform"
        ),
    )


def governance_checkpoint(
    orders_silver: DataFrame,
    *,
    segment_col: str = "origin_platform",
    min_treated: int = 1000,
    take_rate: float = TAKE_RATE,
    coupon_cost: float = COUPON_COST,
    redemption_rate: float = REDEMPTION_RATE,
) -> DataFrame:
    """Weekly break-even readings and whether a segment is to be suspended (EXT5).

    A segment is suspended at a reading when this and the previous one are NEG
    and both rest on at least ``min_treated`` treated users.
    """
    both = treatment_vs_control(
        weekly_users(orders_silver), ["week", segment_col], ids_unique=True
    )
    named = both.withColumnRenamed(segment_col, "segment")
    needed = F.lit(break_even_needed(take_rate, coupon_cost, redemption_rate))
    table = _break_even_columns(
        _economics(named, take_rate, coupon_cost, redemption_rate), needed, ["week"]
    )
    # One row per week and segment by now.
    history = Window.partitionBy("segment").orderBy("week")
    bad = (F.col("status") == "NEG") & (F.col("usuarios_trat") >= min_treated)
    return table.withColumn("failing", bad).select(
        "segment", "week", "usuarios_trat", "gap_uplift", "lucro_por_usuario", "status",
        (F.col("failing") & F.coalesce(F.lag("failing").over(history), F.lit(False))).alias(
            "suspend"
        ),
    )


def cuped_users(
    orders: DataFrame,
    abmap: DataFrame,
    start: str | Column,
    end: str | Column,
) -> DataFrame:
    """Value before and during the experiment per assigned customer with orders in it.

    ``orders`` are conformed and not yet cut to the window. Both sums come from
    one aggregation.
    """
    lo, hi = as_bound(start), as_bound(end)
    past = experiment_window(orders, end=hi)
    during = F.col("event_ts_utc") >= lo
    amount = F.coalesce(F.col("order_total_amount"), F.lit(0.0))
    sums = past.groupBy("customer_id").agg(
        F.count_if(during).alias("frequency"),
        F.sum(F.when(during, amount)).alias("monetary"),
        F.coalesce(F.sum(F.when(~during, amount)), F.lit(0.0)).alias("pre_monetary"),
    )
    return sums.where("frequency > 0").join(
        abmap.where(F.col("is_target").isin(0, 1)), "customer_id"
    )


def cuped_adjust(
    users: DataFrame, *, metric: str = "monetary", covariate: str = "pre_monetary"
) -> DataFrame:
    """Add ``<metric>_cuped``: the metric less what its past explains (EXT3).

    theta = cov(metric, covariate) / var(covariate) over all users, taken from
    one scalar subquery with the covariate's mean.
    """
    require_columns(users, [metric, covariate], "user table")
    fit = users.agg(
        F.struct(
            F.coalesce(
                F.try_divide(F.covar_samp(metric, covariate), F.var_samp(covariate)), F.lit(0.0)
            ).alias("theta"),
            F.avg(covariate).alias("mean"),
        )
    ).scalar()
    adjusted = F.col(metric) - fit["theta"] * (F.col(covariate) - fit["mean"])
    return users.withColumn(f"{metric}_cuped", adjusted)


def cuped_ttest(users: DataFrame, *, metric: str = "monetary") -> DataFrame:
    """Welch test on the raw and the adjusted metric (EXT3)."""
    return welch_ttest(cuped_adjust(users, metric=metric), metrics=[metric, f"{metric}_cuped"])


def assigned_conversion(abmap: DataFrame, users: DataFrame) -> DataFrame:
    """Conversion per arm over everybody assigned, buyers or not (EXT7)."""
    bought = users.select("customer_id", (F.col("frequency") > 0).alias("bought"))
    people = abmap.where(F.col("is_target").isNotNull()).join(bought, "customer_id", "left")
    hit = F.coalesce("bought", F.lit(False))
    return people.groupBy("is_target").agg(
        F.count("*").alias("assigned"),
        F.count_if(hit).alias("converted"),
        F.avg(hit.cast("double")).alias("conversion"),
    )


def poststratified_uplift(
    users: DataFrame, *, segment_col: str = "heavy_user", ids_unique: bool = False
) -> DataFrame:
    """Uplift with both arms weighted to the pooled segment mix (EXT8)."""
    both = treatment_vs_control(users, [segment_col], ids_unique=ids_unique)
    weight = F.col("usuarios_trat") + F.col("usuarios_ctrl")
    uplift = F.col("gmv_trat") - F.col("gmv_ctrl")
    return both.agg(
        F.sum(weight).alias("usuarios"),
        F.try_divide(F.sum(uplift * weight), F.sum(weight)).alias("uplift_adjusted"),
    )

