"""Shards of bounded size by extendible hashing.

Rows have a 96-bit address. A bucket is a prefix of address bits; one that is
over the limit is split on its next bit, the others stay, so hot regions get long
prefixes and the rest short ones. Bits 1-32 come from the MD5 of the id, so a
document keeps its place. Bits 33-96 tell rows of one id apart (the whole number of
the staged row, mixed): no two rows share an address, so copies of an id split as well.

A shard is over the limit only if it holds a single row that is. Null texts have
no bytes; a null id is hashed like an empty one. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stage

STEP = 12
BITS = 96


def _prefix(bits: Column, length) -> Column:
    return F.substring(bits, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def address_bits(id_col: Column, row_number: Column) -> Column:
    """The address as a text of ``BITS`` binary digits."""
    word = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8)
    high = F.lpad(F.conv(word, 16, 2), 32, "0")
    # Of a single 64-bit number this hash is a bijection; it parts all numbers at once.
    low = F.lpad(F.bin(F.xxhash64(row_number.cast("long"))), 64, "0")
    return F.concat(high, low)


def _leaves(rows: DataFrame, done: int, limit: int) -> DataFrame:
    """Directory entries at ``done + STEP`` bits: the entry's cell and its bucket.

    Totals of all shorter prefixes come from the cells of this step. ``bucket``
    is null where the cell has to be split further.
    """
    deep = min(done + STEP, BITS)
    cells = rows.groupBy(_prefix(F.col("bits"), deep).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")
    )
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(deep))))
    prefix = _prefix(F.col("cell"), F.col("depth"))
    totals = levels.groupBy(prefix.alias("bucket")).agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows")
    )
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    best = (
        levels.select("cell", prefix.alias("bucket"))
        .join(totals.where(fits), "bucket")
        .groupBy("cell")
        .agg(
            F.min_by(
                F.struct("bucket", "shard_bytes", "shard_rows"), F.length("bucket")
            ).alias("leaf")
        )
    )
    return cells.select("cell").join(best, "cell", "left").select("cell", "leaf.*")


def assign_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 32 << 20,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``shard``, ``depth``, ``shard_bytes``.

    Only id, address and size of a row are staged and joined, never its text.
    Each round looks at ``STEP`` more bits of the rows that are still in
    oversized buckets: two rounds for a million shards, more only where copies
    pile up.
    """
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0)).alias("n_bytes"),
        F.monotonically_increasing_id().alias("_row"),
    )
    numbered = stage(narrow, "shard_rows")
    open_rows = numbered.select(
        "_id", "n_bytes", address_bits(F.col("_id"), F.col("_row")).alias("bits")
    )
    done, parts = 0, []
    while True:
        leaves = stage(_leaves(open_rows, done, limit), "shard_directory")
        done = min(done + STEP, BITS)
        cell = _prefix(F.col("bits"), done)
        # The struct makes the key new, so that a hot cell's rows can be split.
        placed = open_rows.withColumn("_cell", F.struct(cell.alias("cell"))).join(
            leaves.withColumn("_cell", F.struct("cell")).drop("cell"), "_cell", "left"
        )
        parts.append(placed.where("bucket is not null"))
        if leaves.where("bucket is null").isEmpty():
            break
        open_rows = stage(
            placed.where("bucket is null").select("_id", "n_bytes", "bits"), "shard_open_rows"
        )
    result = None
    for part in parts:
        result = part if result is None else result.unionByName(part)
    return result.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.concat(F.lit("b"), F.col("bucket")).alias("shard"),
        F.length("bucket").alias("depth"),
        "shard_bytes",
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Documents as Parquet, a folder per shard. Needs ids that are unique and not null."""
    (
        docs.join(shards.select(id_col, "shard"), id_col)
        .repartition("shard")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
