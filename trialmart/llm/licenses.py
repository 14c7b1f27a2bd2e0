"""Licence texts in documents, by Dice similarity of word bigrams.

Compared are the whole text, its paragraphs and its lines, each in lower case and
without punctuation. A unit of ``a`` distinct bigrams can reach the threshold ``t``
only with a template whose number lies between ``a * t / (2 - t)`` and
``a * (2 - t) / t``; all other templates are left out before anything is compared.

Everything is column expressions on the row itself, so nothing is shuffled and
repeated rows or ids do not matter. Null texts and texts of one word have no bigram
and no licence. Ties go to the licence first in the alphabet. Columns of the
input with the names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import nest
from .license_texts import TEMPLATES
from .pii import let

MATCH = "struct<score:double,license:string>"


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words, hashed."""
    def pairs(words: Column) -> Column:
        return F.array_distinct(
            F.zip_with(
                F.slice(words, F.lit(1), F.size(words) - 1),
                F.slice(words, F.lit(2), F.size(words)),
                lambda a, b: F.xxhash64(a, b),
            )
        )

    return let(
        normal_words(text),
        lambda words: F.when(F.size(words) > 1, pairs(words)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def template_bigrams(spark: SparkSession, templates: Mapping[str, str]) -> list[tuple[str, list[int]]]:
    """Bigrams of the given templates, computed by the same expression."""
    row = spark.range(1).select(
        *[bigrams(F.lit(templates[name])).alias(f"t{i}") for i, name in enumerate(sorted(templates))]
    ).first()
    return list(zip(sorted(templates), row))


def units(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[\x20\t\r]*\n")
    return F.array_distinct(F.concat(lines, paragraphs, F.array(text)))


def find_licenses(
    docs: DataFrame,
    text_col: str = "text",
    *,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """``docs`` with ``license`` and ``dice`` of the best match, null if there is none.

    The templates are given by hand and become constants of the expression.
    """
    known = [(n, b) for n, b in template_bigrams(docs.sparkSession, templates) if b]
    sizes = [len(b) for _, b in known]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def compare(own: Column) -> Column:
        size = F.size(own)
        matches = []
        for name, theirs in known:
            constant = F.split(F.lit(",".join(map(str, theirs))), ",").cast("array<bigint>")
            common = F.size(F.array_intersect(own, constant))
            score = 2.0 * common / (size + len(theirs))
            possible = (size * low <= len(theirs)) & (size * high >= len(theirs))
            matches.append(
                F.when(possible, F.struct(score.alias("score"), F.lit(name).alias("license")))
            )
        # The best score; of equal ones the first licence.
        best = F.filter(F.array(*matches), lambda m: m["score"] >= threshold)
        return F.aggregate(
            best,
            F.lit(None).cast(MATCH),
            lambda a, m: F.when(a.isNull() | (m["score"] > a["score"]), m.cast(MATCH)).otherwise(a),
        )

    def judge(unit: Column) -> Column:
        def sized(own: Column) -> Column:
            size = F.size(own)
            some = (size * high >= min(sizes)) & (size * low <= max(sizes))
            return F.when(some, compare(own))

        return let(bigrams(unit), sized)

    new = ("license", "dice")
    if not known:
        best = F.lit(None).cast(MATCH)
    else:
        found = F.filter(F.transform(units(F.col("text")), judge), lambda m: m.isNotNull())
        best = F.aggregate(
            found,
            F.lit(None).cast(MATCH),
            lambda a, m: F.when(
                a.isNull()
                | (m["score"] > a["score"])
                | ((m["score"] == a["score"]) & (m["license"] < a["license"])),
                m,
            ).otherwise(a),
        )
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in new]
    marked = nest(docs, text=text_col).select("row", best.alias("best"))
    return marked.select(
        *kept, F.col("best.license").alias("license"), F.col("best.score").alias("dice")
    )
