"""Languages: held-out accuracy, mixtures, and EM against a plain version."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trialmart.llm import catalog, frames, langid

SYLLABLES = {"aa": ["ba", "bo", "mi"], "bb": ["krz", "pst", "wod"], "cc": ["ñan", "yül", "ça"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def predictions(spark, learned, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    return {r["doc_id"]: r for r in langid.predict(df, *learned, **options).collect()}


def test_mixtures_and_edges(spark, learned):
    rng = random.Random(2)
    half = text_of(rng, "aa", 60) + ". " + text_of(rng, "bb", 40)
    rows = [
        (1, text_of(rng, "bb", 50), "old"), (2, half, None), (3, None, None), (4, "", None),
        (5, "12 34 !!", None), (6, text_of(rng, "cc", 400_000), None), (7, half, "x"), (8, "ba", None),
    ]
    found = predictions(spark, learned, rows)
    assert found[1]["lang_pred"] == "bb" and found[1]["score"] == 1.0
    assert found[2]["lang_pred"] == "aa" and abs(found[2]["score"] - 0.6) < 0.03
    assert found[2]["lang_mix"].startswith("aa:0.6") and "bb:" in found[2]["lang_mix"]
    assert {found[i]["lang_pred"] for i in (3, 4, 5)} == {"und"}
    assert all(found[i]["score"] == 0.0 for i in (3, 4, 5))
    assert found[6]["lang_pred"] == "cc" and found[7]["lang_mix"] == found[2]["lang_mix"]


def test_empty_tables_and_nothing_learned(spark, learned):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).count() == 0
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(rows).first()["lang_pred"] == "und"


def test_em_against_a_plain_version():
    rng = np.random.default_rng(3)
    likelihoods = rng.uniform(0.01, 1, (40, 3))
    likelihoods /= likelihoods.max(axis=1, keepdims=True)
    starts = np.array([0, 15])
    sets, shares = langid.mixtures(likelihoods, starts, penalty=0.0, max_set=2)
    for d, (a, b) in enumerate([(0, 15), (15, 40)]):
        rows = likelihoods[a:b]
        first, second = sets[d]
        assert first == np.log(rows).sum(axis=0).argmax()
        if second < 0:
            continue

        def value(share):
            return sum(math.log(share * r[first] + (1 - share) * r[second]) for r in rows)

        best = max(np.linspace(0.001, 0.999, 999), key=value)
        assert value(shares[d, 0]) > value(best) - 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.op2_language_id(spark, sf).where("held_out").select("doc_id", "lang_pred")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    joined = found.join(docs, "doc_id")
    assert joined.where("lang_pred = lang").count() >= 0.97 * joined.count() > 0


def test_more_than_four_languages(spark):
    rng = random.Random(4)
    names = "abcdefg"
    syllables = {n: [n + "x" * k + chr(0x3B1 + i) for k in range(3)] for i, n in enumerate(names)}

    def words(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))

    rows = [(i, words(lang, 30), lang) for i, lang in enumerate(names * 10)]
    known = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "\n".join(words(lang, 40) for lang in names)
    mix = dict(p.split(":") for p in predictions(spark, known, [(1, text, None)])[1]["lang_mix"].split(","))
    assert set(mix) == set(names) and all(abs(float(s) - 1 / 7) < 0.02 for s in mix.values())


def test_memory_does_not_grow_with_the_batch():
    rng = random.Random(9)
    texts = pa.array([text_of(rng, lang, 150) for lang in SYLLABLES for _ in range(800)])
    model = np.log(np.random.default_rng(1).random((langid.BUCKETS, 3))).astype(np.float32)
    label = langid.labeller(sorted(SYLLABLES), model)
    tracemalloc.start()
    one = label(texts.slice(0, 100))
    tracemalloc.reset_peak()
    every = label(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(every[0]) == len(texts) and [x[:100] for x in every] == list(one)
    assert peak < 24 << 20


def test_input_is_sent_once(spark):
    df = spark.createDataFrame([("a b", 1), (None, 2)], "text string, k int")
    widths = frames.append_columns(df, "text", "n long", lambda: lambda column: [[len(x or "") for x in column.to_pylist()]])
    assert [tuple(r) for r in widths.collect()] == [("a b", 1, 3), (None, 2, 0)]
    over = frames.append_columns(df, "text", "text long", lambda: lambda column: [[len(x or "") for x in column.to_pylist()]])
    assert [tuple(r) for r in over.collect()] == [(1, 3), (2, 0)]
    assert "_input" not in widths._jdf.queryExecution().analyzed().toString()
