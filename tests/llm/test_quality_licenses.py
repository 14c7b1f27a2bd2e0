"""Line rules and licence scans against plain versions."""

from __future__ import annotations

import random
import re

from .helpers import documents, quality_counts, sentence
from trialmart.llm import licenses, quality
from trialmart.llm.license_texts import TEMPLATES


def test_counts_by_the_book(spark):
    rng = random.Random(1)
    texts = [None, "", "   \n ", "a", "a b c a b c", "é x y # $", "x " * 60_000, "w" * 300_000]
    for _ in range(120):
        words = sentence(rng, rng.randint(1, 120), "ab")
        glue = [rng.choice([" ", "  ", "\n", "\t", " | ", "\v", "\r\n"]) for _ in words]
        texts.append("".join(a + b for a, b in zip(words, glue)))
    rows = list(enumerate(texts)) + [(3, "a"), (None, "a b")]
    found = quality.clean_documents(documents(spark, rows).withColumnRenamed("source", "kept"))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
            r["n_repeat_words"], r["base_failed"]) for r in found.collect()]
    want = [(i, *quality_counts(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality.clean_documents(documents(spark, [])).count() == 0


def test_line_rules_and_loss(spark):
    rng = random.Random(2)
    body = [" ".join(sentence(rng, 20)) + "." for _ in range(6)]
    menu = "Home | News | About | Contact | Login"
    notice = "All rights reserved."
    shouting = " ".join(w + "!!" for w in sentence(rng, 200))
    rows = [
        (1, "\n".join(body)), (2, "\n".join([menu, *body, notice, body[0]])),
        (3, "\n".join([*body[:3], shouting])),
    ]
    found = {r["doc_id"]: r for r in quality.clean_documents(documents(spark, rows), clean_text=True).collect()}
    assert found[1]["kept"] and found[1]["text_clean"] == rows[0][1]
    assert found[2]["kept"] and found[2]["n_failed_lines"] == 3
    assert found[2]["text_clean"] == "\n".join(body)
    assert not found[3]["kept"] and not found[3]["base_failed"]


def dice(a, b):
    a, b = ({tuple(x) for x in zip(w, w[1:])} for w in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_licences_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [None, "", "one", "x y", *TEMPLATES.values()]
    for body in TEMPLATES.values():
        words = body.split()
        for _ in range(3):
            edited = [w if rng.random() > 0.08 else "zzz" for w in words]
            texts.append("\n".join([" ".join(sentence(rng, 30)), " ".join(edited), "end."]))
        half = len(words) // 2
        texts.append("intro\n\n" + " ".join(words[:half]) + "\n" + " ".join(words[half:]) + "\n \nend")
    rows = list(enumerate(texts)) + [(4, texts[4])]

    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    def best(text):
        found = None
        for unit in {*(text or "").split("\n"), *re.split(r"\n[ \t\r]*\n", text or ""), text or ""}:
            for name in sorted(TEMPLATES):
                score = dice(words(unit), words(TEMPLATES[name]))
                if score >= 0.8 and (found is None or (-score, name) < found):
                    found = (-score, name)
        return (None, None) if found is None else (found[1], round(-found[0], 9))

    docs = documents(spark, rows).withColumnRenamed("lang", "license")
    got = [(r["doc_id"], r["license"], r["dice"] and round(r["dice"], 9))
           for r in licenses.find_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, *best(t)) for i, t in rows], key=str)
    assert licenses.find_licenses(documents(spark, []), templates={}).count() == 0
