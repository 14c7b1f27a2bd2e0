"""Shards within their limit, and the best buckets by brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from .helpers import documents
from trialmart.llm import packing, sharding


def test_shards_fit_and_split_only_where_needed(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60)) for i in range(300)]
    rows += [(-1, "copy of one id")] * 150 + [(None, None), (None, "no id"), (-2, "y" * 5000)]
    found = sharding.assign_shards(documents(spark, rows), limit=400).collect()
    assert len(found) == len(rows)
    totals: dict[str, list[int]] = {}
    for r in found:
        totals.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 400 or len(v) == 1 for v in totals.values())
    for r in found:
        assert r["shard_bytes"] == sum(totals[r["shard"]]) and r["depth"] == len(r["shard"]) - 1
    # Prefixes cover the address space once; a parent of any shard would be too large.
    names = sorted(totals)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))
    for name in names:
        if len(name) > 1:
            below = [sum(v) for n, v in totals.items() if n.startswith(name[:-1])]
            count = sum(len(v) for n, v in totals.items() if n.startswith(name[:-1]))
            assert sum(below) > 400 and count > 1


def test_small_and_empty_tables(spark):
    one = sharding.assign_shards(documents(spark, [(1, "a")])).first()
    assert one["shard"] == "b" and one["depth"] == 0
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    assert packing.pack(documents(spark, [(1, None), (2, " \n")])).count() == 0
    assert packing.pack(documents(spark, [])).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, [(i, "t" * i) for i in range(40)])
    sharding.write_shards(docs, sharding.assign_shards(docs, limit=100), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(40))


def test_limits_are_the_best():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(np.arange(1, 40), n, replace=False))
        counts = rng.integers(1, 20, n)

        def padding(limits):
            at = np.searchsorted(limits, lengths)
            return int(((np.array(limits)[at] - lengths) * counts).sum())

        for k in (1, 2, 3):
            ends = [
                [*c, lengths[-1]]
                for r in range(min(k, n))
                for c in itertools.combinations(lengths[:-1], r)
            ]
            found = packing.best_limits(lengths, counts, k)
            assert len(found) <= k and padding(found) == min(map(padding, ends))


def test_batches_hold_the_budget_and_all_tokens(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 90)) for i in range(400)] + [(7, "a b")] * 30 + [(None, "c")]
    docs = documents(spark, rows)
    found = packing.pack(docs, max_tokens=64, n_buckets=4, batch_tokens=300, slice_rows=25)
    batches = found.groupBy("batch", "padded_to").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top")
    ).collect()
    assert len({b["batch"] for b in batches}) == len(batches)
    for b in batches:
        assert b["n"] == b["slots"] == b["top"] + 1 and b["n"] * b["padded_to"] <= 300
    for size in {b["padded_to"] for b in batches}:  # all but one are full
        part = [b["n"] for b in batches if b["padded_to"] == size]
        assert sum(n < 300 // size for n in part) <= 1
    tokens = found.agg(F.sum("n_tokens")).first()[0]
    assert tokens == sum(len((t or "").split()) for _, t in rows)
    assert found.where("n_tokens > padded_to or n_tokens > 64").count() == 0


def test_rows_of_one_id_in_many_partitions_part(spark):
    docs = documents(spark, [(None, "x" * 100)] * 24).repartition(24)
    docs = docs.unionByName(documents(spark, [(None, "x" * 100)] * 24).repartition(24))
    totals: dict[str, int] = {}
    for r in sharding.assign_shards(docs, limit=150).collect():
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["n_bytes"]
    assert len(totals) == 48 and max(totals.values()) == 100


def test_slices_stay_small_when_ids_are_null_or_repeat(spark):
    rows = [(None, "a b c")] * 400 + [(7, "a b c")] * 400 + [(i, "a b c") for i in range(400)]
    found = packing.pack(documents(spark, rows), max_tokens=8, batch_tokens=30, slice_rows=100)
    batches = found.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"))
    assert {(b["n"], b["slots"]) for b in batches.collect()} == {(10, 10)} and found.count() == 1200
    numbered = documents(spark, rows).withColumn("_row", F.monotonically_increasing_id())
    sizes = packing.in_slices(numbered, F.lit(12)).groupBy("_slice").count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) < 160
