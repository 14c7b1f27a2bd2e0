"""Periodic runs against the definition, tried at every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .helpers import BLANK_WORD, documents, sentence
from trialmart.llm import catalog, periodic_runs


def runs_by_definition(words, exponent=4, min_words=6):
    """Maximal stretches of every period; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        for i in range(q, len(words) + 1):
            if i < len(words) and words[i] == words[i - q]:
                continue
            if i - start >= max(min_words, exponent * q):
                found.setdefault((start, i - start), q)
            start = i - q + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    words = re.findall(BLANK_WORD, text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in
              ("".join(f"{s},{k},{q}\n" for s, k, q in sorted(runs, key=lambda r: (r[0], r[2]))), kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def test_runs_of_all_periods_by_definition():
    rng = random.Random(5)
    texts = []
    for trial in range(250):
        words = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(1, 3)):
            period = rng.choice([1, 2, 3, 7, 15, 16, 17, 18, 21, 22, 25, 33, 40, 64, 101])
            letters = rng.choice(["a", "ab", "aab", "abcdefghijklmnop"])
            block = [rng.choice(letters) for _ in range(period)]
            words += (block * 7)[: int(period * rng.uniform(2.5, 6.5))]
            words += [rng.choice("abz") for _ in range(rng.randint(0, 9))]
        texts.append(words)
    # Nearly periodic periods: long stretches of one word in each.
    texts.append((["a"] * 100 + ["b"]) * 5)
    texts.append((["a", "b"] * 40 + ["b"]) * 6)
    texts.append(["a"] * 5000)
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6]
    numbers = [np.array([ord(w) for w in t], np.int64) for t in texts]
    assert periodic_runs.find_runs(numbers, 4, 6) == [runs_by_definition(t) for t in texts]
    assert periodic_runs.find_runs(numbers[:80], 3, 9) == [runs_by_definition(t, 3, 9) for t in texts[:80]]


def test_minimizers_are_the_minima_of_windows():
    rng = np.random.default_rng(1)
    for size, window in ((40, 1), (40, 7), (40, 40), (200, 33)):
        hashes = rng.integers(0, 30, size).astype(np.uint64)
        want = set()
        for i in range(size - window + 1):
            part = hashes[i : i + window]
            want |= {i + int(j) for j in np.flatnonzero(part == part.min())}
        assert periodic_runs.minimizers(hashes, window).tolist() == sorted(want)


def test_scales_leave_no_period_out():
    covered = [p for w, last in periodic_runs.scales(5000) for p in range(w, last + 1)]
    assert covered[: 5000 - periodic_runs.SHORT] == list(range(periodic_runs.SHORT + 1, 5001))
    assert all(2 * (last - w) <= w // 2 for w, last in periodic_runs.scales(5000))


def query_rows(spark, rows, tmp_path):
    documents(spark, rows).withColumn("n_runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    return catalog.op12_periodic_runs(spark, str(tmp_path)).collect()


def test_query_by_definition(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, "é é x " * 30)]
    rows += [(i, " ".join(sentence(rng, rng.choice([1, 5, 40, 300]), "ab"))) for i in range(10, 150)]
    rows += [(i, "\n".join((sentence(rng, rng.randint(1, 60)) * 9)[: rng.randint(1, 400)])) for i in range(150, 200)]
    rows.append((200, " ".join(sentence(rng, 4000, "abc"))))
    got = [tuple(r) for r in query_rows(spark, rows, tmp_path)]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_operator_texts_and_spans(spark):
    rows = [(1, "x a b a b a b a b y"), (2, None), (3, "p q")]
    found = periodic_runs.collapse_runs(documents(spark, rows), spans=True, clean_text=True)
    got = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and got[1]["text_collapsed"] == "x a b y"
    assert got[2]["text_collapsed"] is None and got[3]["text_collapsed"] == "p q" and got[3]["runs"] == []
    assert periodic_runs.collapse_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(documents(spark, rows), min_exponent=2)
