"""Coupon economics: viability, break-even, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_ids, require_columns, splittable_join
from ..functions.fixed_values import (
    BREAK_EVEN_COLUMNS,
    COUPON_COST,
    REDEMPTION_RATE,
    ROUNDING,
    TAKE_RATE,
)

KEPT_STATUSES = ("OK", "No limite")


def break_even_needed(
    take_rate: float = TAKE_RATE,
    coupon_cost: float = COUPON_COST,
    redemption_rate: float = REDEMPTION_RATE,
) -> float:
    """Extra value per treated user that pays for the coupon (FIN3)."""
    if take_rate <= 0:
        raise ValueError("take_rate must be positive")
    return coupon_cost * redemption_rate / take_rate


def treatment_vs_control(
    users: DataFrame,
    by: Sequence[str] = (),
    *,
    id_col: str = "customer_id",
    group_col: str = "is_target",
    monetary_col: str = "monetary",
    ids_unique: bool = False,
) -> DataFrame:
    """Both arms side by side, for keys that have both; NULL keys drop out (JN7, JN8).

    One pass over the users. The arms meet in a second, tiny aggregation
    instead of a self-join.
    """
    require_columns(users, [*by, id_col, group_col, monetary_col], "user table")
    arms = users.where(F.col(group_col).isin(0, 1))
    for key in by:
        arms = arms.where(F.col(key).isNotNull())
    per_arm = arms.groupBy(*by, group_col).agg(
        count_ids(id_col, ids_unique).alias("n"), F.avg(monetary_col).alias("gmv")
    )
    treated, control = F.col(group_col) == 1, F.col(group_col) == 0
    table = per_arm.groupBy(*by).agg(
        F.max(F.when(treated, F.col("n"))).alias("usuarios_trat"),
        F.max(F.when(control, F.col("n"))).alias("usuarios_ctrl"),
        F.max(F.when(treated, F.col("gmv"))).alias("gmv_trat"),
        F.max(F.when(control, F.col("gmv"))).alias("gmv_ctrl"),
    )
    return table.where(F.col("usuarios_trat").isNotNull() & F.col("usuarios_ctrl").isNotNull())


def _economics(
    table: DataFrame, take_rate: float, coupon_cost: float | Column, redemption_rate: float
) -> DataFrame:
    """Uplift, revenue, cost and profit of the treated users."""
    cost = coupon_cost if isinstance(coupon_cost, Column) else F.lit(float(coupon_cost))
    n = F.col("usuarios_trat")
    uplift = F.col("gmv_trat") - F.col("gmv_ctrl")
    revenue = F.lit(float(take_rate)) * F.col("uplift_gmv_user") * n
    profit = F.col("receita_total") - F.col("custo_total")
    return (
        table.withColumn("uplift_gmv_user", uplift)
        .withColumns(
            {"receita_total": revenue, "custo_total": cost * F.lit(float(redemption_rate)) * n}
        )
        .withColumn("lucro_total", profit)
        .withColumns(
            {
                "lucro_por_usuario": F.when(n > 0, F.col("lucro_total") / n).otherwise(0.0),
                "roi_percent": F.when(
                    F.col("custo_total") > 0,
                    F.try_divide(F.col("lucro_total"), F.col("custo_total")),
                ),
            }
        )
    )


def financial_viability(
    users: DataFrame,
    *,
    take_rate: float = TAKE_RATE,
    coupon_cost: float = COUPON_COST,
    redemption_rate: float = REDEMPTION_RATE,
    id_col: str = "customer_id",
    group_col: str = "is_target",
    monetary_col: str = "monetary",
    ids_unique: bool = False,
) -> DataFrame:
    """One row with uplift, revenue, cost, return, LTV and CAC of the test (FIN1, EXT9).

    A missing arm is an error when the row is computed; an arm without amounts
    counts as 0.
    """
    both = treatment_vs_control(
        users, id_col=id_col, group_col=group_col, monetary_col=monetary_col,
        ids_unique=ids_unique,
    )
    # A global aggregate gives exactly one row, so the check runs even without arms.
    one = both.agg(
        *[F.max(c).alias(c) for c in ("usuarios_trat", "usuarios_ctrl", "gmv_trat", "gmv_ctrl")]
    )
    missing = F.raise_error(F.lit("both arms, control 0 and treatment 1, are needed"))
    one = one.withColumns(
        {
            "usuarios_trat": F.when(F.col("usuarios_trat").isNull(), missing).otherwise(
                F.col("usuarios_trat")
            ),
            "gmv_trat": F.coalesce("gmv_trat", F.lit(0.0)),
            "gmv_ctrl": F.coalesce("gmv_ctrl", F.lit(0.0)),
        }
    )
    money = _economics(one, take_rate, coupon_cost, redemption_rate)
    ltv = F.lit(float(take_rate)) * F.col("gmv_trat")
    return money.select(
        F.col("usuarios_trat").alias("n_treated"),
        F.col("gmv_trat").alias("gmv_user_treat"),
        F.col("gmv_ctrl").alias("gmv_user_ctrl"),
        "uplift_gmv_user",
        *_premises(take_rate, coupon_cost, redemption_rate),
        F.col("receita_total").alias("receita_incremental_total"),
        "custo_total",
        F.col("lucro_total").alias("roi_absoluto"),
        F.col("lucro_por_usuario").alias("roi_por_usuario"),
        ltv.alias("ltv"),
        F.lit(float(coupon_cost)).alias("cac"),
        F.try_divide(ltv, F.lit(float(coupon_cost))).alias("ltv_cac"),
        "roi_percent",
    )


def _premises(take_rate: float, coupon_cost: float, redemption_rate: float) -> list[Column]:
    return [
        F.lit(float(take_rate)).alias("take_rate"),
        F.lit(float(coupon_cost)).alias("coupon_cost"),
        F.lit(float(redemption_rate)).alias("redemption_rate"),
    ]


def finance_by_segment(
    users: DataFrame,
    *,
    segment_col: str,
    take_rate: float = TAKE_RATE,
    coupon_cost: float = COUPON_COST,
    redemption_rate: float = REDEMPTION_RATE,
    id_col: str = "customer_id",
    group_col: str = "is_target",
    monetary_col: str = "monetary",
    ids_unique: bool = False,
) -> DataFrame:
    """The economics per segment that has both arms (FIN2)."""
    both = treatment_vs_control(
        users, [segment_col], id_col=id_col, group_col=group_col, monetary_col=monetary_col,
        ids_unique=ids_unique,
    )
    money = _economics(both, take_rate, coupon_cost, redemption_rate)
    return money.select(
        F.col(segment_col).alias("segment"),
        F.col("usuarios_trat").alias("n_treated"),
        F.col("gmv_trat").alias("gmv_user_treat"),
        F.col("gmv_ctrl").alias("gmv_user_ctrl"),
        "uplift_gmv_user",
        *_premises(take_rate, coupon_cost, redemption_rate),
        F.col("receita_total").alias("receita_incremental_total"),
        "custo_total",
        F.col("lucro_total").alias("lucro_incremental_total"),
        F.col("lucro_por_usuario").alias("roi_por_usuario"),
        "roi_percent",
    ).orderBy("segment")


def profit_status(profit_per_user: Column) -> Column:
    return F.when(profit_per_user >= 0, F.lit("OK")).otherwise(F.lit("NEG"))


def break_even_table(
    users: DataFrame,
    *,
    take_rate: float = TAKE_RATE,
    coupon_cost: float = COUPON_COST,
    redemption_rate: float = REDEMPTION_RATE,
    segment_col: str | None = None,
    id_col: str = "customer_id",
    group_col: str = "is_target",
    monetary_col: str = "monetary",
    ids_unique: bool = False,
) -> DataFrame:
    """Uplift against the break-even, overall or per segment, unrounded (FIN4)."""
    needed = break_even_needed(take_rate, coupon_cost, redemption_rate)
    both = treatment_vs_control(
        users, [segment_col] if segment_col else [], id_col=id_col, group_col=group_col,
        monetary_col=monetary_col, ids_unique=ids_unique,
    )
    named = both.withColumn("segment", F.col(segment_col) if segment_col else F.lit("ALL"))
    return _break_even_columns(
        _economics(named, take_rate, coupon_cost, redemption_rate), F.lit(needed)
    )


def _break_even_columns(money: DataFrame, needed: Column, extra: Sequence[str] = ()) -> DataFrame:
    return money.withColumns(
        {
            "uplift_needed": needed,
            "gap_uplift": F.col("uplift_gmv_user") - needed,
            "status": profit_status(F.col("lucro_por_usuario")),
        }
    ).select(*extra, *BREAK_EVEN_COLUMNS)


def round_break_even(table: DataFrame) -> DataFrame:
    """The table as published: half-even rounding, sorted by segment (FIN5)."""
    digits = {c: d for c, d in ROUNDING.items() if c in table.columns}
    return table.withColumns({c: F.bround(c, d) for c, d in digits.items()}).orderBy("segment")


def treated_counts(
    users: DataFrame, keys: Sequence[str], *, ids_unique: bool = False
) -> DataFrame:
    """Treated users per key combination, ``n``."""
    treated = users.where(F.col("is_target") == 1)
    return treated.groupBy(*keys).agg(count_ids("customer_id", ids_unique).alias("n"))


def _kept(break_even: DataFrame, statuses: Sequence[str], segments: Sequence | None) -> Column:
    """The segments to keep: the listed ones if there is a list, else by status."""
    if segments is None:
        return F.col("status").isin(*statuses)
    return F.col("segment").cast("string").isin(*[_segment_text(s) for s in segments])


def _segment_text(segment: object) -> str:
    return str(segment).lower() if isinstance(segment, bool) else str(segment)


def _coverage(
    counts: DataFrame,
    break_even: DataFrame,
    statuses: Sequence[str],
    segments: Sequence | None = None,
) -> DataFrame:
    """Share of counted users in the segments kept, as one row."""
    kept = break_even.where(_kept(break_even, statuses, segments)).select(
        "segment", F.lit(True).alias("kept")
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    inside = F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0))
    return counts.join(kept, "segment", "left").agg(
        inside.alias("covered"),
        total.alias("treated"),
        (inside / F.greatest(total, F.lit(1))).alias("coverage"),
    )


def coverage_share(
    users: DataFrame,
    break_even: DataFrame,
    *,
    segment_col: str,
    statuses: Sequence[str] = KEPT_STATUSES,
    segments: Sequence | None = None,
    ids_unique: bool = False,
) -> DataFrame:
    """Treated users in kept segments, all treated users, and the share (AGG16).

    ``segments`` lists the segments to keep and takes the place of ``statuses``.

    Users fold to one row per segment before they meet the segments kept. A
    NULL segment counts in the total only.
    """
    counts = treated_counts(users, [segment_col], ids_unique=ids_unique)
    named = counts.withColumnRenamed(segment_col, "segment")
    return _coverage(named, break_even, statuses, segments)


def project_profit(
    break_even: DataFrame,
    *,
    statuses: Sequence[str] = KEPT_STATUSES,
    segments: Sequence | None = None,
    mode: str = "continuo",
    campaigns_per_year: int = 12,
    adjust_coverage: bool = True,
    users: DataFrame | None = None,
    segment_col: str | None = None,
    annual_factor: float | Column = 365.0,
    ids_unique: bool = False,
) -> DataFrame:
    """Yearly projection of the profit of the segments kept (FIN6, FIN7).

    ``segments`` lists the segments to keep and takes the place of ``statuses``.
    ``mode`` is ``continuo`` (times ``annual_factor``) or ``campanhas`` (times
    ``campaigns_per_year``). Coverage scales the yearly figure by the share of
    treated users in those segments when ``users`` and ``segment_col`` are
    given; ``adjust_coverage=False`` leaves it out.
    """
    if mode == "continuo":
        factor = annual_factor if isinstance(annual_factor, Column) else F.lit(float(annual_factor))
    else:
        factor = F.lit(float(campaigns_per_year))
    share = F.lit(1.0)
    if adjust_coverage and users is not None and segment_col is not None:
        share = coverage_share(
            users, break_even, segment_col=segment_col, statuses=statuses,
            segments=segments, ids_unique=ids_unique,
        ).select("coverage").scalar()
    return _projection(break_even, statuses, factor, share, segments)


def _projection(
    break_even: DataFrame,
    statuses: Sequence[str],
    factor: Column,
    share: Column,
    segments: Sequence | None = None,
) -> DataFrame:
    kept = break_even.where(_kept(break_even, statuses, segments))
    row = kept.agg(F.coalesce(F.sum("lucro_total"), F.lit(0.0)).alias("profit"))
    return row.withColumns({"factor": factor, "share": share}).select(
        F.bround("profit", 0).alias("lucro_periodo_selecionados"),
        F.bround(F.col("profit") * F.col("factor") * F.col("share"), 0).alias("projecao_anual"),
        F.col("factor").alias("fator_anual"),
        F.bround("share", 3).alias("cobertura_aplicada"),
    )


def drop_losing_segments(users: DataFrame, break_even: DataFrame, segment_col: str) -> DataFrame:
    """Users outside the segments with status NEG (FLT6).

    Matched on the typed value; users without a segment stay.
    """
    losing = break_even.where(F.col("status") == "NEG").select(F.col("segment").alias(segment_col))
    return splittable_join(users, losing, segment_col, "left_anti")


def project_without_losers(
    users: DataFrame,
    platform_break_even: DataFrame,
    frequency_break_even: DataFrame,
    *,
    platform_col: str = "origin_platform",
    frequency_col: str = "heavy_user",
    campaigns_per_year: int = 12,
    statuses: Sequence[str] = KEPT_STATUSES,
    ids_unique: bool = False,
) -> DataFrame:
    """Projection with coverage counted without loss-making frequency segments (FIN8).

    Users are counted per platform and frequency segment first; the losing
    segments then leave the counts, so the user table is not joined at all.
    """
    counts = treated_counts(users, [platform_col, frequency_col], ids_unique=ids_unique)
    rest = drop_losing_segments(counts, frequency_break_even, frequency_col)
    per_platform = rest.groupBy(F.col(platform_col).alias("segment")).agg(F.sum("n").alias("n"))
    share = _coverage(per_platform, platform_break_even, statuses).select("coverage").scalar()
    return _projection(
        platform_break_even, statuses, F.lit(float(campaigns_per_year)), share
    )
