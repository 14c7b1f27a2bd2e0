"""A training corpus from raw documents: five stages over whole tables.

Each stage takes the documents its predecessor kept, written as Parquet and read
again, and returns documents with the same columns; the last returns the packed
sequences. A stage's working tables go when the next stage is called, as its result
has been written by then.

All stages take nulls in any column, repeated rows and ids, and empty tables. Documents
without text have no language, so the first stage drops them; of a group of equal
documents the smallest id stays (of repeated rows any one).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmart.llm import decontaminate, langid, ngram_join, packing, pii
from trialmart.llm.frames import named_as, renamed, table
from trialmart.sources.storage import drop_folders, folders_made, stage

MIN_SHARE = 0.5

_left: list[str] = []


def _dropping_earlier(function):
    """The stage, after removal of what the stage called before it has staged."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _left)
        _left.clear()
        with folders_made() as made:
            result = function(spark, docs, sf_dir)
        _left.extend(made)
        return result

    return run_stage


@_dropping_earlier
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, or of which none holds half."""
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SHARE)
    at = {c: f"_{docs.columns.index(c)}" for c in ("doc_id", "text", "lang")}
    found = langid.identify(renamed(docs), at["doc_id"], at["text"], at["lang"])
    return named_as(found.where(known), docs)


@_dropping_earlier
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones."""
    return ngram_join.keep_one(docs)


@_dropping_earlier
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


@_dropping_earlier
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs, everywhere=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


@_dropping_earlier
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in batches of similar length."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", private_data),
    ("packing", packed),
]

# Models, alignments and components are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    for name, function in STAGES[:-1]:
        with folders_made() as made:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop_folders(spark, written)
        written = made
    return STAGES[-1][1](spark, docs, sf_dir)
