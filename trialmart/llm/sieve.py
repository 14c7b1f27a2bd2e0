"""A fixed-size bit set over hashed values, as a column expression.

It lets most rows that cannot match be dropped before a shuffle. The size never
depends on the data; a full sieve only lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 20


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS))


def build(values: DataFrame, col: str) -> Column:
    """The sieve of a column's values: at most 16384 numbers reach the driver."""
    slot = _slot(F.col(col))
    words = (
        values.select(F.floor(slot / 64).alias("word"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()
    )
    found = {r["word"]: r["bits"] for r in words}
    text = ",".join(str(found.get(w, 0)) for w in range(BITS // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def passes(sieve: Column, value: Column) -> Column:
    slot = _slot(value)
    word = F.get(sieve, F.floor(slot / 64).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
