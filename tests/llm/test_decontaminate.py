"""Leaks: alignment against the textbook, planted exact and edited passages."""

from __future__ import annotations

import random

import numpy as np

from .helpers import documents, sentence
from trialmart.llm import decontaminate
from trialmart.sources.storage import stage

ITEMS = "item_id long, text string"


def textbook(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            step = decontaminate.MATCH if a == b else decontaminate.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + step, h[i - 1][j] - decontaminate.GAP, h[i][j - 1] - decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == textbook(a.tolist(), b.tolist())


def edit(rng, words, share):
    out = []
    for w in words:
        roll = rng.random()
        if roll < share / 3:
            continue
        out.append("zzz" if roll < 2 * share / 3 else w)
        if roll > 1 - share / 3:
            out.append("yyy")
    return out


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    common = ["of the and", "in to a"]
    items = [(i, " ".join(sentence(rng, 30))) for i in range(25)]
    items += [(25, None), (26, "two words"), (27, items[3][1]), (28, " ".join(sentence(rng, 1500)))]
    rows, want = [], set()
    for i in range(200):
        noise = " ".join(sentence(rng, 40) + [rng.choice(common)])
        rows.append((i, noise))
        if i % 4 == 0:
            item = items[i % 25]
            words = edit(rng, item[1].split(), 0.0 if i % 8 else 0.2)
            rows[-1] = (i, f"{noise}\n{' '.join(words).upper()}!!\n{noise}")
            want.add((i, item[0]))
    long_one = " ".join(sentence(rng, 30_000))
    rows += [(500, None), (501, ""), (502, long_one + " " + items[7][1]), (503, items[28][1]), (0, rows[0][1]), (None, items[5][1])]
    want |= {(502, 7), (503, 28), (None, 5)}
    docs, bench = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    kept = decontaminate.drop_leaked(docs.withColumnRenamed("lang", "leaks"), bench)
    assert kept.columns == ["doc_id", "text", "leaks", "source", "n_chars"]
    leaked = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in leaked)


def test_empty_tables(spark):
    docs, bench = documents(spark, [(1, "a b c d e f")]), spark.createDataFrame([], ITEMS)
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.drop_leaked(docs, bench).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert decontaminate.find_leaks(docs.limit(0), some).count() == 0
    row = decontaminate.find_leaks(docs, some).first()
    assert (row["score"], row["first_word"], row["last_word"]) == (1.0, 0, 5)


def test_no_pattern_of_edits_hides_a_copy(spark):
    """Regular edits, short items, also an item with an exact copy elsewhere."""
    rng = random.Random(5)
    items, rows, want = [], [], set()
    for i in range(60):
        item, every = sentence(rng, rng.choice([6, 10, 15, 30])), 3 + i % 4
        items.append((i, " ".join(item)))
        if i % 5 == 0:
            rows.append((1000 + i, items[-1][1]))
            want.add((1000 + i, i))
        copies = {
            i: ["zzz" if k % every == every - 1 else w for k, w in enumerate(item)],
            200 + i: [x for k, w in enumerate(item) for x in ([w, "yyy"] if k % every == 1 else [w])],
            400 + i: [x for w in item for x in (w, "yyy")],
        }
        for d, words in copies.items():
            words = sentence(rng, 20) + words + sentence(rng, 20)
            rows.append((d, " ".join(words)))
            if textbook(item, words) >= len(item):
                want.add((d, i))
    assert sum(d < 200 for d, _ in want) > 50 and sum(400 <= d < 1000 for d, _ in want) > 50
    found = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_excerpts_of_long_items_are_found(spark):
    rng = random.Random(6)
    long_item, middle, huge = (sentence(rng, n) for n in (500, 59, 1300))
    bench = [(i, " ".join(w)) for i, w in enumerate((long_item, middle, huge))]
    pieces = {
        1: (0, long_item[130:370]), 2: (1, middle[20:45]), 3: (0, long_item[-14:]), 4: (2, huge[500:525]),
        5: (2, huge[1290:] + huge[:9]), 6: (2, [w if k % 9 else "zzz" for k, w in enumerate(huge[700:740])]),
        7: (1, middle[:12]),
    }
    rows = [(d, " ".join(sentence(rng, 80) + p + sentence(rng, 80))) for d, (_, p) in pieces.items()]
    found = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame(bench, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 0), (2, 1), (3, 0), (4, 2), (6, 2)}
    by_doc = {r["doc_id"]: r for r in found}
    assert by_doc[1]["score"] == 0.48 and (by_doc[1]["first_word"], by_doc[1]["last_word"]) == (80, 319)


def hashed(text):
    return next(decontaminate.words_of_texts([decontaminate.plain_text(text)], decontaminate.make_powers()))[1]


def every_pair(rows, items, rules):
    """``{(doc, item): score}`` by aligning every document with every item, no seeds."""
    by_words = {}
    for i, text in items:
        words = hashed(text)
        if len(words):
            old = by_words.get(words.tobytes())
            by_words[words.tobytes()] = i if old is None else old if i is None else min(i, old)
    found = {}
    for d, text in rows:
        doc = hashed(text)
        for key, i in by_words.items():
            for part in decontaminate.segments_of(np.frombuffer(key, np.uint64)):
                score = decontaminate.align(part, doc)[0]
                if score < rules.needed(len(part)):
                    score = decontaminate.align(part, doc, decontaminate.STRICT)[0]
                    if score < rules.excerpt:
                        continue
                share = score / (2 * len(part))
                found[d, i] = max(found.get((d, i), 0), share)
    return found


def test_rare_seeds_lose_nothing(spark):
    """Words so few that every pair is frequent; half of the benchmark is one item."""
    rng = random.Random(7)
    vocabulary = sentence(rng, 25)
    draw = lambda n: [vocabulary[min(int(rng.expovariate(0.25)), 24)] for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([1, 2, 3, 4, 5, 8, 20, 40, 90])))) for i in range(40)]
    items += [(i, items[30][1].upper()) for i in range(100, 140)] + [(None, items[30][1]), (None, "zz yy xx ww vv"), (141, None), (142, ". ,")]
    items.append((150, " ".join(draw(1100))))
    rows = [(500, None), (501, ""), (502, "zz yy xx ww vv"), (503, items[-1][1])]
    for d in range(120):
        source = rng.choice(items[:40] + items[-1:])[1].split()
        at = rng.randrange(len(source))
        piece = edit(rng, source[at : at + rng.randint(3, 60)], rng.choice([0, 0.1, 0.3, 0.5]))
        rows.append((d, " ".join(draw(rng.randint(0, 40)) + piece + draw(rng.randint(0, 40)))))
    docs, bench = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    for options in ({}, {"threshold": 0.7, "min_words": 1, "excerpt_words": 6}, {"excerpt_words": 2, "min_words": 3}):
        rules = decontaminate.Rules(**{"threshold": 0.5, "min_words": 5, "excerpt_words": 13, **options})
        got = decontaminate.find_leaks(docs, bench, **options).collect()
        assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
        assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == every_pair(rows, items, rules)


def test_frequent_seeds_are_left_out(spark):
    rng = random.Random(8)
    item = [w for pair in zip(sentence(rng, 12), ["the", "of"] * 6) for w in pair] + sentence(rng, 10)
    rows = [(i, "the of " * 20 + " ".join(sentence(rng, 5))) for i in range(50)] + [(99, " ".join(item))]
    rules = decontaminate.Rules(0.5, 5, 13)
    words = decontaminate.benchmark_items(spark.createDataFrame([(1, " ".join(item))], ITEMS), "item_id", "text")
    parts = words.selectExpr("explode(segments) words", "item_no s")
    seeds = decontaminate.segment_seeds(parts, rules)
    sieve = decontaminate.build_sieve(seeds)
    counts = decontaminate.count_ngrams(documents(spark, rows), rules, [0, 2], sieve)
    rare = {r["hash"] for r in decontaminate.rare_seeds(seeds, counts).collect()}
    frequent = {r["hash"] for r in counts.where("n > 100").collect()}
    assert frequent and rare and not rare & frequent
    assert len(rare) < seeds.select("hash").distinct().count()


def test_columns_of_any_name(spark):
    item = " ".join(sentence(random.Random(9), 12))
    docs = spark.createDataFrame(
        [(1, "x", 2, None, item), (1, "x", 2, None, item), (2, None, None, None, "clean")],
        "n long, hits string, s int, leaks int, text string",
    )
    bench = spark.createDataFrame([(7, item, 1)], "item_id long, text string, n int")
    kept = decontaminate.drop_leaked(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, None, None, None, "clean")]
    marked = decontaminate.with_leaks(docs, bench)
    assert marked.columns == ["n", "hits", "s", "text", "leaks"]
    assert sorted((r["n"], [tuple(x) for x in r["leaks"]]) for r in marked.collect()) == [
        (1, [(7, 1.0, 0, 11)]), (1, [(7, 1.0, 0, 11)]), (2, []),
    ]


def test_working_tables_hold_texts_once_and_batches_are_short(spark, monkeypatch):
    rng = random.Random(21)
    items = [(i, " ".join(sentence(rng, 30))) for i in range(5)]
    rows = [(i, " ".join(sentence(rng, 60))) for i in range(50)] + [(100 + i, items[i][1]) for i in range(5)]
    batches = {}

    def staged(df, name, batch_rows=None):
        batches[name] = batch_rows, df.columns
        return stage(df, name, batch_rows)

    monkeypatch.setattr(decontaminate, "stage", staged)
    docs = documents(spark, rows).withColumnRenamed("text", "Text")
    kept = decontaminate.drop_leaked(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(50))
    assert batches["documents_with_hits"] == (1000, ["row", "hits", "n"])
    assert batches["benchmark_rare_seeds"][0] == batches["benchmark_leaks"][0] == 1000
