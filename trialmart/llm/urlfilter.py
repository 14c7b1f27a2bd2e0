"""Allow or block URLs: explicit rules first, else boosted trees on lexical features.

The trees learn from labelled URLs; the rules label those they decide. Features are
lengths, depth, digit ratio, entropy, parameters, and how often labelled URLs with the
same endings (last host labels, file suffix, first path segment) were blocked. The
endings are hashed into a fixed number of slots, so their statistics stay small
whatever the crawl; they are counted over all labelled URLs. The trees are fitted on
at most ``max_training_rows`` labelled URLs: of each label half as many different ones,
those with the smallest hashes, so that no repeated URL and no frequent label fills the
sample. Hosts that no rule decides are judged by what the labelled URLs have taught.

A null URL or one without ``://`` has an empty host and path, so no rule fits and the
trees judge it. Without labelled URLs all are allowed; with one kind of label that
kind is the verdict. Repeated rows are judged alike; columns of the input with the
names of result columns are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stage
from .frames import nest

Rule = tuple[str, str]  # verdict, host and path as one text
ALLOW, BLOCK = "allow", "block"
SLOTS = 1024
PRIOR_ROWS = 20.0

LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "dashes",
    "entropy", "parameters", "has_fragment", "is_https",
)
ENDINGS = ("last_label", "last_two_labels", "file_suffix", "first_segment")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    Rules are given by hand, so they become one expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(
            path, F.lit(slash + rest)
        )
        text = F.when(fits, F.lit(rule)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _count(text: Column, one: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(one), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    def add(total: Column, c: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
        return total - share * F.log2(share)

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), add)


def with_features(urls: DataFrame) -> DataFrame:
    """Lexical features and the slots of the endings, from ``_url, host, path``."""
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1)
    two = F.regexp_extract(host, r"([^.]*\.[^.:]*)(?::[0-9]*)?$", 1)
    digits = F.length(url) - F.length(F.translate(url, string.digits, ""))
    features = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "labels": F.when(host == "", 0.0).otherwise(_count(host, ".") + 1),
        "digit_ratio": F.when(url == "", 0.0).otherwise(digits / F.length(url)),
        "dashes": _count(url, "-") + _count(url, "_"),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "has_fragment": F.contains(url, F.lit("#")),
        "is_https": F.startswith(url, F.lit("https:")),
    }
    endings = {
        "last_label": labels,
        "last_two_labels": two,
        "file_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
        "first_segment": F.regexp_extract(path, r"^/([^/]*)", 1),
    }
    return urls.withColumns(
        {k: v.cast("double") for k, v in features.items()}
        | {f"_{k}": F.pmod(F.xxhash64(v), F.lit(SLOTS)).cast("int") for k, v in endings.items()}
    )


def ending_statistics(labelled: DataFrame) -> DataFrame:
    """``(kind, slot, blocked)``: smoothed share of blocked URLs; at most ``SLOTS`` rows a kind."""
    kinds = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("slot")) for k in ENDINGS])
    )
    share = (F.sum("label") + PRIOR_ROWS / 2) / (F.count("*") + PRIOR_ROWS)
    return (
        labelled.select("label", kinds.alias("e"))
        .groupBy("e.kind", "e.slot")
        .agg(share.alias("blocked"))
    )


def _with_statistics(df: DataFrame, statistics: DataFrame) -> DataFrame:
    for k in ENDINGS:
        own = statistics.where(F.col("kind") == k).select(
            F.col("slot").alias(f"_{k}"), F.col("blocked").alias(k)
        )
        # At most SLOTS rows, by construction.
        df = df.join(F.broadcast(own), f"_{k}", "left").fillna(0.5, [k])
    return df


def training_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """Of each label the ``rows / 2`` different URLs with the smallest hashes."""
    different = labelled.distinct()
    halves = [
        different.where(F.col("label") == label).orderBy(F.xxhash64("_url"), "_url").limit(n)
        for label, n in ((0.0, rows // 2), (1.0, rows - rows // 2))
    ]
    return halves[0].unionByName(halves[1])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    url_col: str = "url",
    *,
    labels: DataFrame | None = None,
    max_training_rows: int = 20_000,
    trees: int = 20,
    depth: int = 4,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    ``labels`` (``url``, ``label`` 1 for block) adds labelled URLs to those that
    the rules decide. ``block_score`` is the trees' probability, also where a rule decides.
    """
    def parsed(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("_url", F.coalesce(F.col(f"`{url}`"), F.lit(""))).withColumns(
            {"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}
        )

    new = ("host", "path", "rule", "verdict", "block_score")
    kept = [c for c in pages.columns if c not in new]
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    only_url = parsed(pages.select(F.col(f"`{url_col}`").alias("_raw")), "_raw").drop("_raw")
    by_rule = only_url.withColumn("label", (verdict == BLOCK).cast("double")).where("label is not null")
    labelled = by_rule.select("_url", "host", "path", "label")
    if labels is not None:
        given = parsed(labels, "url").select("_url", "host", "path", F.col("label").cast("double"))
        labelled = labelled.unionByName(given.where("label is not null"))
    featured = with_features(labelled)
    statistics = stage(ending_statistics(featured), "url_statistics")
    sample = with_features(training_sample(labelled, max_training_rows))
    inputs = [*LEXICAL, *ENDINGS]
    training = stage(_with_statistics(sample, statistics).select("label", *inputs), "url_training")
    kinds = [r["label"] for r in training.select("label").distinct().collect()]

    judged = parsed(nest(pages, _raw=url_col), "_raw").withColumns(
        {"rule": rule, "_verdict": verdict}
    )
    if len(kinds) < 2:
        scored = judged.withColumn("block_score", F.lit(kinds[0] if kinds else 0.0))
    else:
        assembler = VectorAssembler(inputCols=inputs, outputCol="_features")
        gbt = GBTClassifier(
            featuresCol="_features", labelCol="label", predictionCol="_prediction",
            maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1,
        )
        gbt.setProbabilityCol("_probability").setRawPredictionCol("_raw_prediction")
        model = gbt.fit(assembler.transform(training.coalesce(4)))
        ready = assembler.transform(_with_statistics(with_features(judged), statistics))
        scored = model.transform(ready).withColumn(
            "block_score", F.get(vector_to_array("_probability"), F.lit(1))
        )
    by_trees = F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        *[F.col(f"row.`{c}`") for c in kept],
        "host",
        "path",
        "rule",
        F.coalesce("_verdict", by_trees).alias("verdict"),
        "block_score",
    )
