"""The queries of this package and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    langid,
    lexical_search,
    licenses,
    ngram_join,
    oracle,
    packing,
    periodic_runs,
    pii,
    quality,
    sharding,
    simhash_dedup,
    urlfilter,
    warc,
)
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        "lang_mix",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, URL_RULES).drop("url")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find_private(docs, everywhere=True))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.find_licenses(docs).select("doc_id", "license", F.round("dice", 6).alias("dice"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, benchmark)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_documents(docs).drop("text")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, benchmark)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", periodic_runs.plant_periods(F.col("text"), F.col("doc_id")))
    return periodic_runs.collapse_runs(planted).drop("text")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.similar_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_license_scans": op6_license_scans,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
}
SQL: dict[str, str] = {
    "op1_warc": oracle.WARC,
    "op3_sharding": oracle.SHARDING,
    "op6_license_scans": oracle.licenses(),
    "op10_quality_rules": oracle.QUALITY,
    "op11_lexical_search": oracle.LEXICAL_SEARCH,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
