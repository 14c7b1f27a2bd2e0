"""SimHash components against all pairs, and the bit-sliced comparison against popcounts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from .helpers import BLANK_WORD, ascii_lower, documents, sentence
from trialmart.llm import catalog, simhash_dedup


def print_of(text):
    words = re.findall(BLANK_WORD, ascii_lower(text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_pairs(prints, ids, radius=3):
    """Smallest id of each row's component; ids may be None."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return [least.get(find(k)) for k in range(len(ids))]


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t", "a", "A", "a b", "a b c", "A  b\nC", "a b c d", "É é x y"]
    for _ in range(10):
        words = sentence(rng, rng.randint(3, 400))
        texts += [" ".join(words)] * rng.randint(1, 4)
        for _ in range(rng.randint(0, 25)):  # each an edit of the one before
            words = list(words)
            words[rng.randrange(len(words))] = sentence(rng, 1)[0]
            texts.append(" ".join(words))
    texts.append(" ".join(sentence(rng, 40_000)))
    rng.shuffle(texts)
    rows = [(5 * i + 2, t) for i, t in enumerate(texts)]
    return rows + [(None, "lone words here now"), (None, texts[0]), rows[3], rows[3]]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 4096), (2, 6)])
def test_query_against_all_pairs(spark, monkeypatch, tmp_path, seed, bucket_rows):
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", bucket_rows)
    rows = corpus(seed)
    documents(spark, rows).withColumn("fp", F.lit("clash")).withColumn("mask", F.lit(0)).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = catalog.op13_simhash(spark, str(tmp_path)).collect()
    prints = [print_of(t) for _, t in rows]
    named = components_by_pairs(prints, [i for i, _ in rows])
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, named)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert len(set(prints)) > len({c for c in named}) > 5


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_close_pairs_are_those_of_popcounts(radius):
    rng = random.Random(radius)
    values = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << b
            values.append(value)
    ends, start = [], 0
    while start < len(values):  # buckets that begin and end anywhere in a word
        size = min(rng.choice([1, 2, 30, 90, 200]), len(values) - start)
        ends += [start + size] * size
        start += size
    want = {
        (i, j) for i in range(len(values)) for j in range(i + 1, ends[i])
        if (values[i] ^ values[j]).bit_count() <= radius
    }
    found = simhash_dedup.close_pairs(np.array(values, np.uint64), np.array(ends), radius)
    assert {(int(a), int(b)) for i, j in found for a, b in zip(i, j)} == want and want


def test_split_masks_cover_all_bits_and_end():
    masks = [0]
    for _ in range(6):
        assert all((1 << 64) - 1 == m | sum(c & ~m for c in simhash_dedup.split_masks(m, 3)) for m in masks[:50])
        masks = [c for m in masks for c in simhash_dedup.split_masks(m, 3)]
    assert max(64 - m.bit_count() for m in masks) <= 12 and len(masks) == 4**6


def test_dense_fingerprints_split_into_bounded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", 40)
    rng = random.Random(9)
    values = {0, (1 << 63) | 5}
    for _ in range(700):  # all within four bits of one value, a chain of neighbours
        value = 0x0F0F00FF12345678
        for b in rng.sample(range(64), rng.randint(0, 4)):
            value ^= 1 << b
        values.add(value)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash_dedup.close_fingerprints(spark.createDataFrame(signed, "fp long"))
    root = {v: v for (v,) in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links.collect():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    named = components_by_pairs(values, list(range(len(values))))
    groups = {}
    for (v,), c in zip(signed, named):
        groups.setdefault(c, set()).add(find(v))
    assert all(len(x) == 1 for x in groups.values())
    assert len({find(v) for (v,) in signed}) == len(set(named))


def test_empty_table(spark):
    assert simhash_dedup.similar_components(documents(spark, [])).count() == 0
