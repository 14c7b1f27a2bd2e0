"""Batches with little padding: optimal length buckets.

All lengths go into one global histogram. Dynamic programming over it finds the
bucket limits with the least padding; inside a bucket, rows form batches of as
many sequences as the token budget holds.

A text longer than ``max_tokens`` becomes several sequences, so nothing is cut
off. Null and empty texts have no sequence. Repeated rows and ids are packed each for
itself, and null ids like others. An empty table has no batches. Other columns are not
read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stage

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def best_limits(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper limits of at most ``n_buckets`` buckets with the least padding.

    ``lengths`` ascend. A bucket ends at a length that occurs, and all its rows are
    padded to it, so a bucket over lengths i..j costs ``length[j]`` times its rows
    less the tokens it holds; the tokens are the same for every choice.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices = []
    best = [(np.inf, 0)]
    for k in range(1, min(n_buckets, n) + 1):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(k, n + 1):
            total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            choice[j] = np.argmin(total)
            new[j] = total[choice[j]]
        cost = new
        choices.append(choice)
        if cost[n] < best[0][0]:
            best = [(cost[n], k)]
    k, j, limits = best[0][1], n, []
    while k:
        limits.append(int(lengths[j - 1]))
        j = int(choices[k - 1][j])
        k -= 1
    return limits[::-1]


def length_histogram(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("n_tokens").agg(F.count("*").alias("n"))


def in_slices(rows: DataFrame, slices: Column) -> DataFrame:
    """``_slice`` from the number of the staged row: ids may be null or repeat in any number."""
    return rows.withColumn("_slice", F.pmod(F.xxhash64("_row"), slices.cast("long")).cast("int"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_tokens: int = 2048,
    n_buckets: int = 8,
    batch_tokens: int = 65536,
    slice_rows: int = 100_000,
    count_tokens=count_words,
) -> DataFrame:
    """One row per sequence: id, ``part``, ``n_tokens``, ``padded_to``, ``batch``, ``slot``.

    The histogram has at most ``max_tokens`` rows, whatever the input, and is all
    that reaches the driver. Ranks inside a bucket come from slices of about
    ``slice_rows`` rows and the totals of the slices before, so no task orders a
    whole bucket and only the last batch of a bucket is not full.
    """
    if not 0 < max_tokens <= batch_tokens:
        raise ValueError("a batch has to hold at least one sequence of max_tokens")
    total = F.coalesce(count_tokens(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    counted = docs.select(F.col(f"`{id_col}`").alias("_id"), total.alias("_total"))
    parts = F.sequence(F.lit(0), F.floor((F.col("_total") - 1) / max_tokens).cast("int"))
    sequences = stage(
        counted.where("_total > 0")
        .withColumn("part", F.explode(parts))
        .select(
            "_id",
            "part",
            F.least(F.lit(max_tokens), F.col("_total") - F.col("part") * max_tokens)
            .cast("int")
            .alias("n_tokens"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "pack_sequences",
    )
    histogram = length_histogram(sequences).toPandas().sort_values("n_tokens")
    lengths = histogram["n_tokens"].to_numpy(np.int64)
    counts = histogram["n"].to_numpy(np.int64)
    limits = best_limits(lengths, counts, n_buckets)
    padded, slices, capacity = F.lit(None).cast("int"), F.lit(1), F.lit(1)
    low = 0
    for limit in reversed(limits):
        padded = F.when(F.col("n_tokens") <= limit, F.lit(limit)).otherwise(padded)
    for limit in limits:
        rows = int(counts[(lengths > low) & (lengths <= limit)].sum())
        slices = F.when(F.col("padded_to") == limit, F.lit(-(-rows // slice_rows))).otherwise(slices)
        capacity = F.when(F.col("padded_to") == limit, F.lit(batch_tokens // limit)).otherwise(capacity)
        low = limit
    sliced = in_slices(sequences.withColumn("padded_to", padded), slices)
    sizes = sliced.groupBy("padded_to", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("padded_to").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "padded_to", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("padded_to", "_slice").orderBy("_id", "part", "_row")
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    rank = F.col("_rank") + F.col("_before")
    batch = F.floor(rank / F.col("_capacity")).cast("long")
    result = ranked.join(stage(offsets, "pack_offsets"), ["padded_to", "_slice"]).withColumn(
        "_capacity", capacity
    )
    return result.select(
        F.col("_id").alias(id_col),
        "part",
        "n_tokens",
        "padded_to",
        F.concat_ws("-", F.col("padded_to"), batch).alias("batch"),
        (rank % F.col("_capacity")).cast("int").alias("slot"),
    )
