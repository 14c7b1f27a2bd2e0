"""The exact join against all pairs, its trees and components, and the copies it keeps."""

from __future__ import annotations

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from .helpers import documents, sentence, shingle_components
from trialmart.llm import ngram_join, signature_tree
from trialmart.llm.components import components
from trialmart.sources.storage import folders_made, stage
from trialmart.llm.words import hash_long_text, make_powers, words_of_texts


def corpus(seed):
    """Copies, chains of edits around the limit, shared passages, odd texts."""
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 60))
    texts = [None, "", " \n", "a", "A  a", "a b c", "a b c d e", "A B c d\te", "a b c d e f"]
    for _ in range(12):
        words = sentence(rng, rng.randint(8, 120))
        texts += [" ".join(words)] * rng.randint(1, 4)
        for _ in range(rng.randint(0, 12)):  # each an edit of the one before
            words = list(words)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = sentence(rng, 1)[0]
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(sentence(rng, rng.randint(0, 40))) for _ in range(60)]
    base = sentence(rng, 90)
    for _ in range(80):  # one dense group
        words = list(base)
        words[rng.randrange(90)] = sentence(rng, 1)[0]
        texts.append(" ".join(words))
    texts.append(" ".join(sentence(rng, 20_000)))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,part_rows", [(1, 2000), (2, 10)])
def test_join_against_all_pairs(spark, monkeypatch, seed, part_rows):
    monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
    rows = corpus(seed)
    found = ngram_join.similar_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == shingle_components(rows)
    assert len(found) == len(rows)


def test_exact_limit(spark):
    base = [f"w{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:10])), (3, " ".join([*base, "x"])), (4, " ".join(base[3:]))]
    found = ngram_join.similar_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == shingle_components(rows)


def test_nulls_repeats_and_clashing_names(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [
        (1, long), (1, long), (2, long), (None, long + " x"), (5, None), (5, ""), (None, "a b c"),
        (None, "a b c"), (9, "z y x"), (9, "z y w"),
    ]
    docs = documents(spark, rows).withColumnRenamed("lang", "_key").withColumnRenamed("source", "v")
    found = sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str)
    assert found == sorted(
        [(1, 9, 1), (1, 9, 1), (2, 9, 1), (None, 10, 1), (5, 0, 5), (5, 0, 5), (None, 1, None),
         (None, 1, None), (9, 1, 9), (9, 1, 9)], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, long), (5, None), (5, ""), (None, "a b c"), (9, "z y x"), (9, "z y w")], key=str)
    assert ngram_join.similar_components(docs.limit(0)).count() == 0
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_traversal_loses_no_similar_pair():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(150):
        own = base[rng.integers(6)].copy()
        own[rng.choice(40, rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 63)
        sets.append(np.unique(own))
    sets.sort(key=len)
    bits = np.array([signature_tree.bitmap(s) for s in sets])
    sizes, labels = np.array([len(s) for s in sets]), np.arange(150)
    def similar(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 7 * both >= 3 * (len(sets[a]) + len(sets[b]))
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if similar(a, b)}
    tree = signature_tree.build(bits, sizes, labels)
    got = {(a, b) for i, j in signature_tree.dual_traversal(tree, None, 3, 4) for a, b in zip(i.tolist(), j.tolist())}
    assert want <= got and len(got) < 150 * 149 / 2 / 3
    half = signature_tree.build(bits[:40], sizes[:40], labels[:40]), signature_tree.build(bits[40:], sizes[40:], labels[40:])
    got = {(a, b + 40) for i, j in signature_tree.dual_traversal(*half, 3, 4) for a, b in zip(i.tolist(), j.tolist())}
    assert {(a, b) for a, b in want if a < 40 <= b} <= got
    same = signature_tree.build(bits, sizes, np.zeros(150, int))
    assert not list(signature_tree.dual_traversal(same, None, 3, 4))


def test_tables_hold_only_sets_that_may_be_similar(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sentence(rng, 400))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(5)]
    with folders_made() as made:
        found = ngram_join.similar_components(documents(spark, rows).repartition(3)).collect()
    want = {i: (396, i) for i in range(300)} | {300 + i: (397, i) for i in range(5)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    held = [spark.read.parquet(p) for p in made]
    sets = [t for t in held if "shingles" in t.columns]
    assert sets and all(t.where("shingles is not null").count() <= 30 for t in sets)


def test_a_pair_meets_where_the_smaller_set_leads(spark):
    # Sizes 30 and 40, all 30 common: a share of exactly 3 / 4, whichever words are rare.
    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = sentence(rng, 44)
        cut = rng.randint(0, 10)
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[cut : cut + 34])), (3 * k + 2, " ".join(words[cut : cut + 33]))]
    found = ngram_join.similar_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == shingle_components(rows)


def test_classes_that_met_nobody_in_a_block_are_not_sent_again(spark):
    # All share a passage, so they stay in blocks of many components.
    rng = random.Random(13)
    passage = " ".join(sentence(rng, 30))
    rows = [(i, " ".join([*sentence(rng, rng.randint(60, 200)), passage])) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(20)]
    with folders_made() as made:
        found = ngram_join.similar_components(documents(spark, rows).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == shingle_components(rows)
    rounds = [spark.read.parquet(p).count() for p in made if "/join_open_rows-" in p]
    assert len(rounds) > 1 and 5 * rounds[-1] < max(rounds[0], 1000)


def test_traversal_leaves_out_pairs_beyond_reach():
    rng = np.random.default_rng(12)
    bits = np.repeat(rng.integers(0, 1 << 63, (1, 32)).astype(np.uint64), 60, axis=0)
    sizes, labels, reach = np.arange(2000, 2060), np.arange(60), np.arange(2000, 2060) + 30 * (np.arange(60) % 2)
    tree = signature_tree.build(bits, sizes, labels, reach)
    got = {(a, b) for i, j in signature_tree.dual_traversal(tree, None, 3, 4) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if reach[a] >= sizes[b] and reach[b] >= sizes[a]}


def test_reach_covers_every_similar_size(spark):
    # Sets of a and b that first share an element after x of a and y of b.
    rows = [(n, x) for n in [*range(1, 60), 4097] for x in range(ngram_join.prefix_length(n, 3, 4))]
    table = spark.createDataFrame([(n, x, x * ngram_join._PLACES // n) for n, x in rows], "n long, x long, place long")
    reach = ngram_join._reach(table["n"], table["place"], 3, 4)
    for r in table.withColumn("reach", reach).collect():
        sizes = [m for m in range(r["n"] * 3 // 4, r["n"] * 4 // 3 + 2) if 7 * min(r["n"] - r["x"], m) >= 3 * (r["n"] + m)]
        assert r["reach"] >= max(sizes, default=0)


def test_keeping_one_leaves_no_working_tables(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(sentence(rng, 50))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(100, rows[0][1] + " end")] + rows[:3]
    with folders_made() as made:
        kept = ngram_join.keep_one(documents(spark, rows).repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(left) == 1 and "join_flags" in left[0]


def test_traversal_of_wide_bitmaps_holds_few_pairs():
    rng = np.random.default_rng(10)
    bits = rng.integers(0, 1 << 63, (600, 512)).astype(np.uint64)
    sizes, labels = np.full(600, 20_000), np.arange(600)
    tree = signature_tree.build(bits, sizes, labels)
    tracemalloc.start()
    found = sum(len(i) for i, _ in signature_tree.dual_traversal(tree, None, 1, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 600 * 599 // 2 and peak < 64 << 20


def test_staged_rows_go_to_python_in_short_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    table = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["n"] for r in stage(table, "batches", 1000).collect()) == 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    seen = []
    keys = ngram_join._make_keys(1, np.zeros(1 << ngram_join.SIEVE_BITS - 6, np.int64))
    rows = pa.StructArray.from_arrays([pa.array([1, 2, 3]), pa.array(["a b", None, "A b"])], ["id", "t"])
    assert keys(rows.slice(1))[0].tolist() == [0, 1] and len(set(keys(rows)[1])) == 2 and not any(keys(rows)[2])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 200}
    assert {r["vertex"]: r["label"] for r in found} == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_word_hashes_do_not_depend_on_pieces():
    powers, rng = make_powers(), random.Random(6)
    words = [w.encode() for w in sentence(rng, 300_000)] + [b"z" * 3_000_000, b"y" * 100_000]
    rng.shuffle(words)
    text = b" ".join(words)
    assert len(text) > 4 << 20
    alone = {w: int(h[0]) for w in set(words[:2000]) for _, h in words_of_texts([b" " + w], powers)}
    hashes = hash_long_text(text, powers)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert all(int(hashes[i]) == alone[words[i]] for i in range(2000))


def test_components_by_tasks_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (1500, 2))] + [(i, i + 1) for i in range(5000, 5400)]
    root = {v: v for link in links for v in link}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {v: find(v) for v in root}
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    pairs = table.selectExpr("struct(a as n, -a as v) as a", "struct(b as n, -b as v) as b")
    jobs = spark.sparkContext.statusTracker()
    for size in (10_000, 300):
        monkeypatch.setattr("trialmart.llm.components.LINKS", size)
        spark.sparkContext.setJobGroup(f"components-{size}", "")
        found = components(pairs, "a", "b")
        rows = found.collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r["vertex"]["n"]: r["label"]["n"] for r in rows} == want and len(rows) == len(want)
    # A chain that one task holds takes no rounds.
    assert len(jobs.getJobIdsForGroup("components-10000")) <= 6
