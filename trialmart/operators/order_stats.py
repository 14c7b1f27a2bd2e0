"""Exact order statistics without gathering a group.

``percentile`` and ``percentile_disc`` keep every distinct value of a group in
one task, which stops working when a group is half of all users. Here each
metric is cut once into ``n_buckets`` parts of about equal size, with cut points
from one bounded sketch over all rows. Since the cuts ignore the group, a
(group, bucket) cell never holds more than that share of the distinct values,
whatever the sizes of the groups, and equal values are folded before they move.
Ranks are then found in two levels: bucket totals give the bucket and the
offset, and only the cells that hold a wanted rank are sorted.

The cut points decide how the work is split, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_BUCKETS = 256
SKETCH_ACCURACY = 10_000
# Accuracy of the cut points per bucket; they only have to be roughly even.
CUT_ACCURACY = 16


def _cut_points(df: DataFrame, metrics: Sequence[str], n_buckets: int) -> list[str]:
    """Per metric, ``n_buckets - 1`` rising numbers as comma-separated text.

    One job with one mergeable sketch per metric; this bounded list is all that
    reaches the driver. As plain constants the cuts are the same wherever the
    runs are used, so Spark computes and shuffles the runs once.
    """
    # One text literal in place of many number literals keeps planning cheap.
    points = ",".join(str(i / n_buckets) for i in range(1, n_buckets))
    grid = F.expr(f"cast(split('{points}', ',') as array<double>)")
    accuracy = CUT_ACCURACY * n_buckets
    sketches = [
        F.percentile_approx(F.when(~F.isnan(m), F.col(m)), grid, accuracy) for m in metrics
    ]
    found = df.agg(*sketches).first()
    return [",".join(str(c) for c in cuts or [0.0] * (n_buckets - 1)) for cuts in found]


def _bucketed(
    df: DataFrame, metrics: Sequence[str], carry: Sequence[str], n_buckets: int
) -> DataFrame:
    """Long form ``(carry…, metric, value, bucket)`` without NULL and NaN values."""
    if n_buckets < 2 or n_buckets & (n_buckets - 1):
        raise ValueError("n_buckets must be a power of two")
    cuts = " ".join(
        f"when '{m}' then cast(split('{text}', ',') as array<double>)"
        for m, text in zip(metrics, _cut_points(df, metrics, n_buckets))
    )
    keep = [f"`{c}`" for c in carry]
    # A generator, not unpivot: the expansion that one plans to hides from Spark
    # that two uses of the runs are the same shuffle.
    pairs = ", ".join(f"struct('{m}' as metric, `{m}` as value)" for m in metrics)
    long = df.selectExpr(*keep, f"inline(array({pairs}))")
    long = long.where("value is not null and not isnan(value)")
    # Binary search: the bucket is the number of cut points below the value.
    # Each level builds on the one before it in the same select list.
    levels, previous, step = [], "0", n_buckets // 2
    while step:
        hop = f"if(value > element_at(_cuts, {previous} + {step}), {step}, 0)"
        levels.append(f"{previous} + {hop} as _b{step}")
        previous, step = f"_b{step}", step // 2
    found = long.selectExpr(*keep, "metric", "value", f"case metric {cuts} end as _cuts", *levels)
    return found.select(*carry, "metric", "value", F.col(previous).alias("bucket"))


def value_runs(
    df: DataFrame,
    metrics: Sequence[str],
    keys: Sequence[str] = (),
    *,
    group_col: str | None = None,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Distinct values with counts: ``(cell, bucket, value, n)``.

    ``cell`` is a struct of the keys and the metric name; as a struct it groups
    and joins NULL keys like any other. With ``group_col`` the counts are
    ``n_treat`` and ``n_ctrl`` for its values 1 and 0.
    """
    carry = [*keys, *([group_col] if group_col else [])]
    slim = df.select(*carry, *[F.col(m).cast("double").alias(m) for m in metrics])
    if group_col:
        slim = slim.where(F.col(group_col).isin(0, 1))
    long = _bucketed(slim, metrics, carry, n_buckets)
    cell = F.struct(*[F.col(k) for k in keys], F.col("metric")).alias("cell")
    if group_col:
        counts = [
            F.count_if(F.col(group_col) == 1).alias("n_treat"),
            F.count_if(F.col(group_col) == 0).alias("n_ctrl"),
        ]
    else:
        counts = [F.count("*").alias("n")]
    return long.groupBy(cell, "bucket", "value").agg(*counts)


def bucket_totals(runs: DataFrame) -> DataFrame:
    """Rows per cell and bucket with the rows before it and in all (bounded windows)."""
    earlier = "partition by cell order by bucket rows between unbounded preceding and 1 preceding"
    return (
        runs.groupBy("cell", "bucket")
        .agg(F.sum("n").alias("n_bucket"))
        .selectExpr(
            "*",
            f"coalesce(sum(n_bucket) over ({earlier}), 0) as before",
            "sum(n_bucket) over (partition by cell) as total",
        )
    )


def pick_ranks(runs: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Values at 1-based ranks: ``(cell, total, r0, r1, …)``, one row per cell.

    The ranks are SQL expressions that may use ``total``. A rank outside
    ``1..total`` gives NULL, and a cell without any rank inside is absent.
    """
    slots = ", ".join(
        f"struct({i} as slot, cast({rank} as bigint) as rank)" for i, rank in enumerate(ranks)
    )
    holders = bucket_totals(runs).selectExpr(
        "cell", "bucket", "before", "total",
        f"filter(array({slots}), s -> s.rank > before and s.rank <= before + n_bucket) as slots",
    ).where("size(slots) > 0")
    in_cell = "partition by cell, bucket order by value"
    hits = (
        runs.join(holders, ["cell", "bucket"])
        .selectExpr("*", f"before + sum(n) over ({in_cell}) as upto")
        .selectExpr(
            "cell", "total", "value",
            "filter(slots, s -> s.rank <= upto and s.rank > upto - n).slot as hit",
        )
        .where("size(hit) > 0")
    )
    return hits.groupBy("cell").agg(
        F.max("total").alias("total"),
        *[
            F.expr(f"max(value) filter (where array_contains(hit, {i})) as r{i}")
            for i in range(len(ranks))
        ],
    )


def _place(p: float, of: str) -> str:
    # As decimal, so that p * n does not land just above a whole number.
    return f"(cast('{Decimal(str(p)):f}' as decimal(18,12)) * {of})"


def rank_columns(probs: Sequence[float], method: str) -> list[str]:
    """The ranks, in terms of ``total``, that quantiles at ``probs`` are made of."""
    if method == "disc":
        return [f"greatest(1, ceil({_place(p, 'total')}))" for p in probs]
    if method != "cont":
        raise ValueError("method must be 'disc' or 'cont'")
    lows = [f"floor({_place(p, '(total - 1)')})" for p in probs]
    return [rank for low in lows for rank in (f"{low} + 1", f"least({low} + 2, total)")]


def quantile_columns(
    probs: Sequence[float], method: str, through: str = "{value}"
) -> list[str]:
    """Quantiles as SQL over the values at ``rank_columns``, named ``r0, r1, …``.

    ``through`` is an expression applied to those values first; if it rises with
    the value, the result is the quantile of the transformed metric.
    """
    if method == "disc":
        return [through.format(value=f"r{i}") for i, _ in enumerate(probs)]
    columns = []
    for i, p in enumerate(probs):
        place = _place(p, "(total - 1)")
        below, above = (through.format(value=f"r{2 * i + k}") for k in (0, 1))
        columns.append(f"{below} + ({above} - {below}) * cast({place} - floor({place}) as double)")
    return columns


def quantiles_of_runs(runs: DataFrame, probs: Sequence[float], method: str = "disc") -> DataFrame:
    """``(cell, total, q0, q1, …)`` from value runs."""
    values = quantile_columns(probs, method)
    return pick_ranks(runs, rank_columns(probs, method)).select(
        "cell", "total", *[F.expr(v).alias(f"q{i}") for i, v in enumerate(values)]
    )


def quantile_table(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    *,
    method: str = "disc",
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Quantiles per key and metric: ``(keys…, metric, total, q0, q1, …)``.

    ``disc`` returns the smallest value whose cumulative share reaches p,
    ``cont`` interpolates linearly between neighbours, ``approx`` is a sketch
    with bounded memory and one shuffle of sketches, for dashboards.
    """
    if method == "approx":
        slim = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
        long = slim.unpivot(list(keys), list(metrics), "metric", "value")
        sketch = F.percentile_approx("value", list(probs), SKETCH_ACCURACY)
        return (
            long.where(F.col("value").isNotNull())
            .groupBy(*keys, "metric")
            .agg(F.count("*").alias("total"), sketch.alias("s"))
            .select(*keys, "metric", "total",
                    *[F.col("s")[i].alias(f"q{i}") for i in range(len(probs))])
        )
    runs = value_runs(df, metrics, keys, n_buckets=n_buckets)
    found = quantiles_of_runs(runs, probs, method)
    return found.select("cell.*", "total", *[f"q{i}" for i in range(len(probs))])


def quantile_struct(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    *,
    method: str = "disc",
    n_buckets: int = N_BUCKETS,
) -> Column:
    """Whole-table quantiles as one scalar subquery: ``struct<metric: array<double>>``.

    Without rows the arrays hold NULLs.
    """
    table = quantile_table(df, metrics, probs, method=method, n_buckets=n_buckets)
    arrays = [
        F.array(
            *[F.max(F.when(F.col("metric") == m, F.col(f"q{i}"))) for i in range(len(probs))]
        ).alias(m)
        for m in metrics
    ]
    return table.agg(F.struct(*arrays)).scalar()


def attach_to_runs(runs: DataFrame, per_cell: DataFrame) -> DataFrame:
    """Give every run the columns of its cell.

    Joining on the cell alone would send a large group to one task, so the
    columns are first spread over the buckets of the cell (a bounded number of
    rows) and joined on cell and bucket.
    """
    spread = runs.select("cell", "bucket").distinct().join(per_cell, "cell")
    return runs.join(spread, ["cell", "bucket"])

