"""URL rules by the book; trees that learn; no Python in the plan."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from trialmart.llm import urlfilter
from trialmart.llm.catalog import URL_RULES

PAGES = "page_id long, url string, verdict string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def rule_of(host, path):
    best = None
    for verdict, rule in URL_RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


EDGES = [
    None, "", "no scheme", "HTTPS://A.Example.ORG/es/x?y#z", "http://org?x", "http://org",
    "http://notorg/", "a\nb://X.com/de/\n", "://com/fr/", "http://ÉX.COM/fr/", "http://a://b.org/x",
    "http://x.com/de?/de/", "http://www.example.org/en/12", "http://example.org/en/2",
    "http://com/fr/" + "a1" * 50_000,
]


def test_rules_by_the_book(spark):
    rng = random.Random(1)
    urls = EDGES + [
        "http" + rng.choice(["s", ""]) + "://" + rng.choice(["a.", "b.c.", ""])
        + rng.choice(["org", "example.org", "com", "x.com", "net"])
        + rng.choice(["", "/", "/es/", "/en/1", "/fr/", "/de/", "/en/2"]) + rng.choice(["", "?q=/de/", "#x", "7"])
        for _ in range(150)
    ]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, None, "x")], PAGES)
    rows = urlfilter.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path = parse(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        rule = rule_of(host, path)
        assert r["rule"] == (rule and rule[1])
        assert r["verdict"] == rule[0] if rule else r["verdict"] in ("allow", "block")


def test_without_or_with_one_kind_of_label(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", None), (2, "http://y.org/", None)], PAGES)
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, ()).collect()} == {"allow"}
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, [("block", "org/")]).collect()} == {"block"}
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_trees_learn_from_labelled_urls_and_run_no_python(spark):
    rng = random.Random(2)

    def url(bad):
        words = "".join(rng.choice("0123456789xyz") for _ in range(20)) if bad else "about"
        return f"http://h{rng.randint(0, 50)}.net/{words}" + ("?a=1&b=2" if bad else "")

    labels = spark.createDataFrame([(url(i % 2), i % 2) for i in range(400)], "url string, label int")
    pages = spark.createDataFrame([(i, url(i % 2), None) for i in range(200)], PAGES)
    judged = urlfilter.judge_urls(pages, (), labels=labels, trees=5)
    right = (F.col("verdict") == "block") == (F.col("page_id") % 2 == 1)
    assert judged.where(right).count() >= 195
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_features_by_the_book(spark):
    url = "https://a-b.Example.com/x_1/y2?p=1&q=2#f"
    row = spark.createDataFrame([(url,)], "_url string").withColumns(
        {"host": urlfilter.host_of(F.col("_url")), "path": urlfilter.path_of(F.col("_url"))}
    )
    f = urlfilter.with_features(row).first()
    share = [n / len(url) for n in Counter(url).values()]
    assert math.isclose(f["entropy"], -sum(s * math.log2(s) for s in share))
    assert (f["depth"], f["labels"], f["parameters"], f["dashes"]) == (2.0, 3.0, 2.0, 2.0)
    assert math.isclose(f["digit_ratio"], 4 / len(url))


def test_a_hot_url_does_not_fill_the_training_sample(spark):
    rows = [(f"http://h{i}.net/{'x1' * 9 if i % 2 else 'about'}", i % 2) for i in range(60)]
    labels = spark.createDataFrame(rows + [rows[0]] * 900 + [("http://c.net/", 0), ("http://c.net/", 1)], "url string, label int")
    named = labels.selectExpr("url _url", "cast(label as double) label")
    sample = urlfilter.training_sample(named, 21).collect()
    assert len(set(sample)) == len(sample) == 21 and sum(r["label"] for r in sample) == 11
    assert urlfilter.training_sample(named, 1000).count() == 62
    pages = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(rows)], PAGES)
    judged = urlfilter.judge_urls(pages, (), labels=labels, trees=5, max_training_rows=40)
    assert judged.where((F.col("verdict") == "block") == (F.col("page_id") % 2 == 1)).count() == 60
