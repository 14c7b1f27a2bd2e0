"""Samples that come out the same on every run, cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def sample_hash(id_col: str, seed: int) -> Column:
    """A number in [0, 2**32) taken from the md5 of id and seed."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def in_sample(id_col: str, fraction: float, seed: int) -> Column:
    """Whether an id belongs to the sample of this size.

    A smaller fraction with the same seed is a subset of a larger one.
    """
    return sample_hash(id_col, seed) < F.lit(int(fraction * HASH_RANGE))
