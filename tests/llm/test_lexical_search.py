"""Ranked search against scoring every document, and the index against its definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .helpers import ascii_lower, documents, sentence
from trialmart.llm import lexical_search, oracle
from verification.compare import connect, difference

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, ascii_lower(text or ""))


def ranked(rows, queries, k=10):
    """``{(query id, rank): (doc, score)}`` by scoring all documents."""
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in set(queries):
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * len(held) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(q, place, i, -s) for place, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = sentence(rng, 300) + ["É", "été", "x1", "日本"]
    def text(n):
        words = [vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n)]
        return "".join(w + rng.choice([" ", ", ", "\n", "-", "... "]) for w in words)
    rows = [(0, None), (1, ""), (2, " .,;_"), (3, "A"), (3, "A"), (None, text(20)), (None, text(9))]
    rows += [(10 + i, text(rng.choice([1, 3, 20, 120]))) for i in range(400)]
    copy = text(30)
    rows += [(1000 - i, copy) for i in range(60)]  # a large group of copies, ties by id
    rows += [(2000 + i, copy + f" only{i}") for i in range(30)]
    rows.append((5000, text(30_000)))
    rng.shuffle(rows)
    queries = [(i, text(rng.randint(1, 25))) for i in range(30)]
    queries += [(100, copy), (101, copy), (102, None), (103, ""), (104, "nowhere zzz9"), (105, "日本 日本 A")]
    queries += [(106, "x1 X1 x1"), (106, "x1 X1 x1"), (107, "!!")]
    return rows, queries


@pytest.mark.parametrize("postings,query_bytes", [(1 << 19, 8 << 20), (300, 1500)])
def test_search_scores_like_all_documents(spark, monkeypatch, postings, query_bytes):
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    rows, queries = corpus(3)
    docs = documents(spark, rows).withColumn("id", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit(7))
    found = lexical_search.search(docs, asked, max_query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == ranked(rows, queries) and len(got) > 250


def test_other_ids_and_places(spark):
    rows = [("b", "red fox"), ("a", "red fox"), ("c", "red"), (None, "red fox fox")]
    docs = spark.createDataFrame(rows, "name string, body string")
    asked = spark.createDataFrame([("q", "fox")], "who string, words string")
    found = lexical_search.search(
        docs, asked, id_col="name", text_col="body", query_id_col="who", query_col="words", k=2
    )
    assert [(r["who"], r["rank"], r["name"]) for r in found.orderBy("rank").collect()] == [("q", 1, None), ("q", 2, "a")]


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(documents(spark, []), asked).count() == 0
    assert lexical_search.search(documents(spark, [(1, None)]), asked).count() == 0
    assert lexical_search.search(documents(spark, [(1, "a")]), asked.where("false")).count() == 0


def test_sparse_table_gives_range_maxima():
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(70):
        held = np.flatnonzero(rng.random(12) < 0.5)
        docs.append((int(rng.integers(5, 90)), held, rng.integers(1, 9, len(held))))
    index = lexical_search.Index(docs, rng.integers(1, 5000, 12), 70, 3000)
    for begin, end in index.lists.values():
        for a in range(begin, end):
            for b in range(a + 1, end + 1):
                place = int(index.greatest(np.array([a]), np.array([b]))[0])
                assert a <= place < b and index.impact[place] == index.impact[a:b].max()
    assert index.greatest(np.array([3]), np.array([3]))[0] == len(index.doc)


def test_search_gives_up_intervals(monkeypatch):
    """With one clear winner few documents are scored."""
    rng = np.random.default_rng(5)
    docs = [(50, np.arange(4), rng.integers(1, 3, 4)) for _ in range(5000)]
    docs[1234] = (50, np.arange(4), np.full(4, 40))
    index = lexical_search.Index(docs, np.full(4, 900), 5000, 250_000)
    best, scored = lexical_search.Best(1), []
    best.ids = [[i] for i in range(5000)]
    offer = best.offer
    monkeypatch.setattr(best, "offer", lambda score, doc: (scored.append(doc), offer(score, doc)))
    index.search({0: 1, 1: 1, 2: 2, 3: 1}, best)
    assert best.rows[0][2] == 1234 and scored == [1234]


def test_sql_on_a_small_scale(spark):
    from trialmart.llm import catalog

    folder = "/root/testdata/sf0.001"
    statement = oracle.LEXICAL_SEARCH
    assert difference(catalog.op11_lexical_search(spark, folder), connect(folder), statement) is None
