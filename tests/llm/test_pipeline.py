"""The five stages on planted documents, and the queries on the smallest tables."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from .helpers import documents, sentence
from trialmart.llm import catalog
from verification.compare import connect, difference

SF_DIR = entry_points.SMOKE_DIR


def test_stages_keep_what_is_clean(spark, tmp_path):
    rng = random.Random(1)
    item = " ".join(sentence(rng, 30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, " ".join(sentence(rng, 60)) + ".") for i in range(30)]
    rows = clean + [
        (100, clean[4][1]), (101, clean[5][1] + " one more"), (102, None), (103, "12 34"),
        (104, clean[6][1][:40] + " " + item), (105, " ".join(sentence(rng, 50)) + " me@mail.org"),
    ]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["language ID", "n-gram Jaccard join"]
    gone = set()
    for (_, stage), leave in zip(corpus_pipeline.STAGES[:4], [{102, 103}, {100, 101}, {104}, set()]):
        docs = corpus_pipeline.stage(stage(spark, docs, str(tmp_path)), "test-stage")
        gone |= leave
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in rows} - gone
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[105].endswith("[EMAIL]") and all(texts[i] == t for i, t in clean)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(texts)
    assert packed.columns == ["doc_id", "part", "n_tokens", "padded_to", "batch", "slot"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_with_sql(spark, name):
    assert difference(catalog.queries()[name](spark, SF_DIR), connect(SF_DIR), catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_cover_their_tables(spark, name):
    df = catalog.queries()[name](spark, SF_DIR)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name not in ("op7_decontamination", "op9_packing"):
        key = "page_id" if "page_id" in df.columns else "doc_id"
        table = "pages" if key == "page_id" else "documents"
        want = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
        assert len({r[key] for r in rows}) == len(rows) == want
