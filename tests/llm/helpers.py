"""Small documents and plain versions of the methods."""

from __future__ import annotations

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, rows):
    """Rows ``(doc_id, text)`` as a table of documents."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng: random.Random, n: int, letters: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingle_components(rows):
    """``{doc_id: (set size, smallest reachable id)}`` by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(BLANK_WORD, ascii_lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality_counts(text):
    """Base columns of the quality rules, by the book."""
    text = text or ""
    words = re.findall(BLANK_WORD, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(BLANK_WORD, x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(hit), n < 50 or 100 * len(hit) > 50 * n,
    )
