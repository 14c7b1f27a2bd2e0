"""RFM scores and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.fixed_values import RFM_QUANTILES
from .order_stats import N_BUCKETS, quantile_struct

DEFAULT_SEGMENTS = ("heavy_user", "is_new_customer", "origin_platform", "rfm_segment")
_SCORES = {"recency": ("r_score", False), "frequency": ("f_score", True),
           "monetary": ("m_score", True)}


def _score(value: Column, cuts: Column, n_cuts: int, ascending: bool) -> Column:
    """Bin number 1..n+1 of ``(cut, next cut]`` bins; NULL value or cuts give 3."""
    bins = n_cuts + 1
    above = sum(
        (F.when(value > cuts[i], F.lit(1)).otherwise(F.lit(0)) for i in range(1, n_cuts)),
        F.when(value > cuts[0], F.lit(1)).otherwise(F.lit(0)),
    )
    bin_no = above + 1 if ascending else F.lit(bins) - above
    return F.when(value.isNotNull() & cuts[0].isNotNull(), bin_no).otherwise(F.lit(3))


def build_rfm_buckets(
    users: DataFrame,
    *,
    qcuts: Sequence[float] = RFM_QUANTILES,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Add ``r_score``, ``f_score``, ``m_score`` and ``rfm_segment`` (SEG1, SEG2).

    The cuts of all three columns come from one scalar subquery; scoring itself
    moves no rows. Recent users score high.
    """
    require_columns(users, list(_SCORES), "user table")
    qcuts = sorted(qcuts)
    cuts = quantile_struct(users, list(_SCORES), list(qcuts), n_buckets=n_buckets)
    cut_cols = {f"_cuts_{c}": cuts[c] for c in _SCORES}
    scored = users.withColumns(cut_cols).withColumns(
        {
            score: _score(F.col(c), F.col(f"_cuts_{c}"), len(qcuts), ascending)
            for c, (score, ascending) in _SCORES.items()
        }
    )
    return scored.drop(*cut_cols).withColumn(
        "rfm_segment", F.concat_ws("", "r_score", "f_score", "m_score")
    )


def rfm_tiers(scored: DataFrame) -> DataFrame:
    """Add ``rfm_tier`` by the score sum: 3-7 low, 8-11 mid, 12-15 high (EXT6)."""
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    tier = F.when(total <= 7, "low").when(total <= 11, "mid").otherwise("high")
    return scored.withColumn("rfm_tier", tier)


def rfm_for_sample(scored: DataFrame, sample: DataFrame) -> DataFrame:
    """Segments of the sampled customers only (FLT7, JN9)."""
    ids = sample.select("customer_id")
    return scored.join(ids, "customer_id", "left_semi").select("customer_id", "rfm_segment")
