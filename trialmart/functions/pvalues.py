"""Two-sided p-values as column expressions.

Spark SQL has no error function and no t distribution. Both tails are ratios of two
integrals of the same curve, so no gamma function is needed:

    t = sqrt(df) * tan(s / sqrt(df))  turns the density of t into  cos(s / sqrt(df)) ** (df - 1)

and the normal curve ``exp(-s * s / 2)`` is its limit. The integrals are Simpson sums
of a fixed number of points. They run in the JVM, on the few rows of a finished
test table.

The exact distribution of a rank test is counted in numpy, also on finished rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the exact test counts with travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 6000
# Beyond so many more units of s the curve has nothing left that a double can show.
REACH = 12.0


def _simpson(low: Column, high: Column, curve: Callable[[Column], Column]) -> Column:
    step = (high - low) / STEPS

    def add(total: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * curve(low + i * step)

    points = F.sequence(F.lit(0), F.lit(STEPS))
    return F.aggregate(points, F.lit(0.0), add) * step / 3.0


def _column(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def z_pvalue(z: Column | str) -> Column:
    """Both tails of the normal distribution; NULL for NULL and NaN."""
    size = F.abs(_column(z))
    tail = _simpson(size, size + REACH, lambda s: F.exp(-s * s / 2.0))
    p = F.least(F.lit(1.0), tail / math.sqrt(math.pi / 2))
    return F.when(size.isNotNull() & ~F.isnan(size), p)


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Both tails of Student's t; NULL without positive degrees of freedom."""
    size, freedom = F.abs(_column(t)), _column(df)
    root = F.sqrt(freedom)

    def curve(s: Column) -> Column:
        # At the end of the range the cosine is 0 up to rounding.
        return F.pow(F.greatest(F.cos(s / root), F.lit(0.0)), freedom - 1.0)

    end = root * (math.pi / 2)
    start = root * F.atan(size / root)
    tail = _simpson(start, F.least(end, start + REACH), curve)
    half = _simpson(F.lit(0.0), F.least(end, F.lit(REACH)), curve)
    valid = size.isNotNull() & ~F.isnan(size) & ~F.isnan(freedom) & (freedom >= 1.0)
    return F.when(valid, F.least(F.lit(1.0), tail / half))


def rank_sum_counts(m: int, n: int, most: int) -> np.ndarray:
    """In how many of the orders of ``m`` and ``n`` distinct values U is 0, 1, ... ``most``.

    These are the partitions of U into at most ``m`` parts of at most ``n``: the
    coefficients of the product of (1 - q^(n+i)) / (1 - q^i) for i up to m, built up factor
    by factor. Divisions come first, so all terms are positive until the end. Counts
    beyond 2^53 are rounded to doubles, an error of the last digits.
    """
    ways = np.zeros(most + 1)
    ways[0] = 1
    for i in range(1, m + 1):
        padded = np.zeros(-(-len(ways) // i) * i)
        padded[: len(ways)] = ways
        ways = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[: most + 1]
    for i in range(1, m + 1):
        if n + i <= most:
            ways[n + i :] = ways[n + i :] - ways[: most + 1 - n - i]
    return ways


def exact_u_pvalue(u: float, n_treat: int, n_ctrl: int) -> float:
    """Both tails of Mann-Whitney's U without ties: twice the smaller one, at most 1."""
    m, n = sorted((int(n_treat), int(n_ctrl)))
    low = int(min(u, n_treat * n_ctrl - u))
    tail = float(rank_sum_counts(m, n, low).sum())
    return min(1.0, 2 * tail / math.comb(m + n, m))


@F.pandas_udf(T.DoubleType())
def exact_u_pvalues(
    parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    """Row by row; NULL where U is NULL."""
    for u, n_treat, n_ctrl in parts:
        rows = zip(u, n_treat, n_ctrl)
        yield pd.Series([None if pd.isna(x) else exact_u_pvalue(x, a, b) for x, a, b in rows], dtype="float64")
