"""Base spans against plain patterns, disclosing terms against plain counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from .helpers import documents
from trialmart.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [
        (k, m.start(), m.end(), m.group())
        for k, p in PLAIN.items()
        for m in re.finditer(p, text or "")
        if valid(k, m.group())
    ]


def text_list(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


PARTS = [
    "a@b.c", "x_", ".d", "@", "1.2.3.4", "255.", "4111 1111 1111 1111", "+49 (30) 1234567", "-", "5",
    "😀", "0000", "+1", " ", "\n", "é", "256.1.1.1", "001.002.003.0004",
]


def test_base_spans_by_the_book(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.@-+%_1234567890 ().é😀\n") for _ in range(rng.randint(0, 60))) for _ in range(700)]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(700)]
    texts += [None, "", "7" * 30_000, "a" * 30_000 + "@", "a@b" + ".c" * 20_000, "+49 30 123456 y@z.de " * 2000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "q@w.e")]
    found = pii.report(pii.find_private(documents(spark, rows), support=10**9)).collect()
    want = []
    for i, t in rows:
        spans = plain_spans(t)
        n = Counter(k for k, *_ in spans)
        listed = text_list(spans)
        want.append((i, *[n[k] for k in pii.KINDS], hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def plain_terms(rows, slack, support):
    """Disclosing ``{(term, entity): bits}`` by counting one text after the other."""
    n_term, n_near = Counter(), Counter()
    for _, text in rows:
        text = text or ""
        n_term.update(re.findall(r"[^\W\d_]{3,}", text.lower()))
        for kind in PLAIN:
            matches = list(re.finditer(PLAIN[kind], text))
            for i, m in enumerate(matches):
                if not valid(kind, m.group()):
                    continue
                before = text[matches[i - 1].end() if i else 0 : m.start()][-64:]
                after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else None][:64]
                if len(before) == 64:
                    before = re.sub(r"^[^\W\d_]+", "", before)
                if len(after) == 64:
                    after = re.sub(r"[^\W\d_]+$", "", after)
                digits = re.sub("[^0-9]", "", m.group())
                entity = f"{kind}:{digits if kind in ('card', 'phone') else m.group().lower()}"
                n_near.update({(t, entity) for t in re.findall(r"[^\W\d_]{3,}", (before + " " + after).lower())})
    found = {}
    for (t, e), n in n_near.items():
        bits = max(0.0, math.log2(n_term[t] / n)) if n >= support else 99
        if bits <= slack:
            found[t, e] = bits
    return found


def test_disclosing_terms_by_the_book(spark):
    rng = random.Random(4)
    people = [(f"p{i}@mail.org", f"nick{'abcdefgh'[i]}", f"town{'abcdefgh'[i]}") for i in range(8)]
    rows = []
    for i in range(160):
        mail, nick, town = people[i % 8]
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(rng.randint(0, 25)))
        rows.append((i, rng.choice([
            f"{filler} {nick} writes to {mail} from {town} {filler}", f"{town} and {nick} without an address",
            f"{mail.upper()} {filler}", f"{filler} {town} {filler}",
        ])))
    rows += [(900, None), (901, "nicka alone"), (902, rows[0][1])]
    terms = plain_terms(rows, 1.0, 3)
    assert terms
    want = {}
    for i, text in rows:
        base = plain_spans(text)
        entities = {f"email:{v.lower()}" for k, _, _, v in base}
        own = {t for (t, e) in terms if e in entities}
        extra = [
            ("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "")
            if m.group().lower() in own and not any(a < m.end() and m.start() < b for _, a, b, _ in base)
        ]
        want[i] = text_list(base + extra)
    docs = documents(spark, rows).withColumnRenamed("lang", "pii").withColumnRenamed("source", "_row")
    found = pii.report(pii.find_private(docs)).collect()
    assert {r["doc_id"]: r["spans"] for r in found} == want and len(found) == len(rows)
    assert any("term" in s for s in want.values())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("@" not in (t or "") for t in clean.values())
    assert all(clean[i] == t for i, t in rows if not want[i])
    assert pii.sanitise(docs).columns == docs.columns


def test_overlaps_go_as_one_and_empty_tables_work(spark):
    docs = documents(spark, [(1, "call +1.2.3.4 5678901 or 1.2.3.4, ok"), (2, None), (3, "")])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[2] is None and clean[3] == ""
    assert not re.search(r"[0-9]", clean[1]) and clean[1].startswith("call ") and clean[1].endswith(", ok")
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.find_private(documents(spark, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_terms_go_everywhere_and_also_without_the_address(spark):
    rows = [(i, f"zorro writes to z@mail.org today, number {i}") for i in range(5)]
    rows += [(10, "Zorro alone"), (11, "nobody here"), (12, None), (13, "zorro and x@y.z"), (10, "Zorro alone")]
    docs = documents(spark, rows)
    found = pii.report(pii.find_private(docs, everywhere=True)).collect()
    got = sorted((r["doc_id"], r["spans"]) for r in found if r["doc_id"] > 9)
    assert got == [(10, "term:0:5"), (10, "term:0:5"), (11, ""), (12, ""), (13, "email:10:15,term:0:5")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, everywhere=True).collect()}
    assert "zorro" not in clean[10].lower() and clean[11] == "nobody here" and clean[12] is None


def test_terms_near_very_many_entities(spark):
    rows = [
        (i, f"hotword u{i % 60}@mail.org name{chr(97 + i % 60 // 26)}{chr(97 + i % 60 % 26)}z")
        for i in range(240)
    ] + [(999, None), (1000, "hotword alone")]
    docs = documents(spark, rows)
    found = pii.find_private(docs).select("doc_id", F.explode("pii").alias("p"))
    got = {(r["doc_id"], r["p"]["start"], r["p"]["end"]) for r in found.where("p.kind = 'term'").collect()}
    terms = plain_terms(rows, 1.0, 3)
    assert terms and not any(t == "hotword" for t, _ in terms)
    want = set()
    for i, text in rows:
        entities = {f"email:{v.lower()}" for _, _, _, v in plain_spans(text)}
        own = {t for t, e in terms if e in entities}
        base = plain_spans(text)
        want |= {
            (i, m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "") if m.group().lower() in own
            and not any(a < m.end() and m.start() < b for _, a, b, _ in base)
        }
    assert got == want
