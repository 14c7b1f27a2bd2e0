"""Line-first cleaning of documents.

Every line is judged on its own by three rules (punctuation, navigation,
boilerplate). Lines that fail go; a document goes when it is too short, repeats
itself, or loses too much of its text with them.

Null text counts as empty: no words, so it fails. Texts are read whole. Repeated
rows are judged one by one. Columns of the input with the names of result
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import append_columns, utf8
from .words import make_powers, shingle_hashes, words_of_texts

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Line rules.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_PUNCTUATION = 5
SEPARATORS = ("|", ">", "/", "-", "·", "•", "»", "«", "›", "→")
MIN_SEPARATORS = 3
PHRASES = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign up",
    "subscribe now",
    "terms of use",
)
MAX_BOILERPLATE_WORDS = 25

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_failed_lines long, failed_chars long, kept boolean"
)


def repeated_words(words: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    windows = shingle_hashes(words, 3)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def line_judge(max_punctuation: float) -> Callable[[bytes, list[bytes], int], bool]:
    """Whether a line fails, given its bytes, its words and their code points."""
    separators = {s.encode() for s in SEPARATORS}
    phrases = [p.encode() for p in PHRASES]

    def fails(line: bytes, words: list[bytes], chars: int) -> bool:
        marks = len(line) - len(line.translate(None, PUNCTUATION))
        if marks >= MIN_PUNCTUATION and marks > max_punctuation * chars:
            return True
        parts = sum(w in separators for w in words)
        if parts >= MIN_SEPARATORS and 5 * parts >= len(words):
            return True
        if len(words) <= MAX_BOILERPLATE_WORDS:
            plain = line.lower()
            return any(p in plain for p in phrases)
        return False

    return fails


def _code_points(data: bytes) -> int:
    return len(data) - int((np.frombuffer(data, np.uint8) & 0xC0 == 0x80).sum())


def clean_documents(
    docs: DataFrame,
    text_col: str = "text",
    *,
    max_punctuation: float = 0.15,
    max_loss: float = 0.5,
    clean_text: bool = False,
) -> DataFrame:
    """``docs`` with counts, the base verdict and ``kept``.

    ``failed_chars`` are the code points of words in failing lines; a document is
    kept when the base rules hold and at most ``max_loss`` of its ``word_chars``
    is lost. ``clean_text`` adds the text without the failing lines as
    ``text_clean`` (null for null).
    """
    ddl = COLUMNS + (", text_clean string" if clean_text else "")

    def make():
        powers = make_powers()
        fails = line_judge(max_punctuation)
        symbols = SYMBOLS.encode()

        def judge(column: pa.Array):
            texts = utf8(column)
            found = [[] for _ in range(10 if clean_text else 9)]
            for i, hashes in words_of_texts(texts, powers):
                data = texts[i]
                chars, dup, failed, lost = 0, 0, 0, 0
                seen, left = set(), []
                for line in data.split(b"\n"):
                    words = line.split()
                    if not words:
                        left.append(line)
                        continue
                    here = _code_points(b"".join(words)) if not line.isascii() else sum(
                        map(len, words)
                    )
                    chars += here
                    again = line in seen
                    dup += again
                    seen.add(line)
                    if again or fails(line, words, here):
                        failed += 1
                        lost += here
                    else:
                        left.append(line)
                n = len(hashes)
                repeats = repeated_words(hashes)
                base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
                row = [
                    n, chars, len(data) - len(data.translate(None, symbols)), dup, repeats,
                    base, failed, lost, not base and lost <= max_loss * chars,
                ]
                if clean_text:
                    row.append(b"\n".join(left).decode() if column[i].is_valid else None)
                for values, value in zip(found, row):
                    values.append(value)
            return found

        return judge

    return append_columns(docs, text_col, ddl, make)
