"""Runs of words that repeat with a period, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least ``max(min_words, min_exponent * q)`` words, which neither
neighbouring word extends. Every run of a text is found, whatever its period:

* Periods up to ``SHORT`` by comparing the words of each lag directly.
* Longer ones in scales. A scale takes care of the periods from w to w + k/2 with
  k = w/2. All positions whose hash of k words is the smallest in some window of w
  words are its minimizers. Inside a run the smallest hash comes back at distance q,
  so each minimizer is paired with the first equal one at distance w or more, and
  the pair is extended to both sides. One occurrence at least has no other within k/2
  words before it, or the k words and so the run would have a smaller period; from
  there the first equal one at distance w or more is at q. There are never more
  pairs than words.

A stretch of period q also has the multiples of q; the smallest found is the period.
Words are compared as such, hashes only propose pairs.

Null text counts as empty, and empty texts and texts without a word have no run.
Texts are read whole; memory is some times the longest text. Repeated rows are treated one by one. Columns
of the input with the names of result columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import append_columns, utf8
from .words import mix

SHORT = 16
GROUP_WORDS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

COLUMNS = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _powers(base: int, n: int) -> np.ndarray:
    up = np.full(n, base, np.uint64)
    up[:1] = 1
    return np.cumprod(up, dtype=np.uint64)


def _gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.view(np.uint64)) * _powers(_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * _powers(_INVERSE, n - k + 1))


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``size`` values, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window, all equal ones."""
    smallest = _sliding(hashes, window, np.minimum)
    low = np.zeros(window - 1, np.uint64)
    best = _sliding(np.concatenate([low, smallest, low]), window, np.maximum)
    return np.flatnonzero(best == hashes)


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """``(w, last period)`` of the scales up to a longest period."""
    w = SHORT + 1
    while w <= longest:
        last = w + w // 2 // 2
        yield w, last
        w = last + 1


def _equal_pairs(values: np.ndarray, w: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, distance)``: each minimizer and the first equal one from ``w`` words on."""
    k = w // 2
    hashes = _gram_hashes(values, k)
    at = minimizers(hashes, w - k + 1)
    own = hashes[at]
    # Places in order of (hash, position), so equal ones are neighbours.
    order = np.argsort(own, kind="stable")
    own, at = own[order], at[order]
    group = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    width = len(values) + last + 1
    keys = group * width + at
    mate = np.searchsorted(keys, keys + w)
    inside = np.flatnonzero(mate < len(at))
    mate = mate[inside]
    good = (group[inside] == group[mate]) & (at[mate] - at[inside] <= last)
    first = at[inside][good]
    return first, at[mate][good] - first


def _matches(values: np.ndarray, at: int, lag: int, forward: bool) -> int:
    """So many positions from ``at`` on (or before it) equal those ``lag`` further."""
    total, size = 0, 64
    while True:
        if forward:
            begin, end = at + total, min(at + total + size, len(values) - lag)
        else:
            begin, end = max(at - total - size, 0), at - total
        if begin >= end:
            return total
        other = np.flatnonzero(values[begin:end] != values[begin + lag : end + lag])
        if len(other):
            return total + int(other[0] if forward else end - begin - 1 - other[-1])
        total += end - begin
        size *= 2


def _stretches_by_lag(values: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches of ``least`` words or more that keep a period."""
    same = np.flatnonzero(values[lag:] == values[:-lag])
    if len(same) < least - lag:
        return
    cuts = np.flatnonzero(np.diff(same) != 1)
    begins = np.concatenate([same[:1], same[cuts + 1]])
    ends = np.concatenate([same[cuts], same[-1:]]) + 1
    for i in np.flatnonzero(ends - begins >= least - lag):
        yield int(begins[i]), int(ends[i]) + lag


def _stretches_by_pairs(values: np.ndarray, w: int, last: int, exponent: int):
    first, distance = _equal_pairs(values, w, last)
    for lag in np.unique(distance).tolist():
        at = np.sort(first[distance == lag])
        i = 0
        while i < len(at):
            here = int(at[i])
            begin = here - _matches(values, here, lag, False)
            end = here + lag + _matches(values, here, lag, True)
            if end - begin >= exponent * lag:
                yield begin, end, lag
            # Pairs up to here lie in the same stretch.
            i = max(i + 1, int(np.searchsorted(at, end - lag)))


def find_runs(texts: list[np.ndarray], exponent: int, min_words: int) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each text, given as arrays of word numbers.

    The texts are searched side by side. Numbers that occur nowhere else stand
    between them, so no run crosses over.
    """
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]

    def together(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = [i for i, t in enumerate(texts) if len(t) >= least]
        parts = [x for i in chosen for x in (texts[i], np.array([-1 - i]))]
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in chosen])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), starts, np.array(chosen)

    def add(begin: int, end: int, period: int, starts: np.ndarray, chosen: np.ndarray) -> None:
        place = int(np.searchsorted(starts, begin, "right")) - 1
        key = (begin - int(starts[place]), end - begin)
        own = found[chosen[place]]
        own[key] = min(period, own.get(key, period))

    for lag in range(1, SHORT + 1):
        least = max(min_words, exponent * lag)
        values, starts, chosen = together(least)
        for begin, end in _stretches_by_lag(values, lag, least):
            add(begin, end, lag, starts, chosen)
    for w, last in scales(max(map(len, texts), default=0) // exponent):
        values, starts, chosen = together(max(min_words, exponent * w))
        for begin, end, lag in _stretches_by_pairs(values, w, last, exponent):
            if end - begin >= min_words:
                add(begin, end, lag, starts, chosen)
    return [sorted((s, n, p) for (s, n), p in own.items()) for own in found]


def _groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    group, size = [], 0
    for text in texts:
        words = text.split()
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _numbers(group: list[list[bytes]]) -> list[np.ndarray]:
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    return [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in group]


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def collapse_runs(
    docs: DataFrame,
    text_col: str = "text",
    *,
    min_exponent: int = 4,
    min_words: int = 6,
    spans: bool = False,
    clean_text: bool = False,
) -> DataFrame:
    """``docs`` with the number of runs, the longest one, and digests.

    Of the longest runs the one that starts first counts. ``runs_sha256`` is that of a
    line ``start,length,period`` for every run, ``collapsed_sha256`` that of the
    words outside runs and in the first period of a run, joined by blanks. ``spans``
    adds all ``runs`` as an array, ``clean_text`` the words left as ``text_collapsed``
    (null for null).
    """
    if min_exponent < 3:
        raise ValueError("the scales find runs of three periods or more")
    more = ", runs array<struct<start:long,length:long,period:long>>" if spans else ""
    more += ", text_collapsed string" if clean_text else ""

    def make():
        def search(column: pa.Array):
            rows = []
            for group in _groups(utf8(column)):
                for words, runs in zip(group, find_runs(_numbers(group), min_exponent, min_words)):
                    kept = words
                    if runs:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in runs:
                            edges[start + period] += 1
                            edges[start + length] -= 1
                        kept = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                    left = b" ".join(kept)
                    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                    milli = 1000 * best[1] // best[2] if runs else None
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
                    row = [len(runs), *best, milli, _sha256(lines.encode()), _sha256(left)]
                    if spans:
                        row.append(runs)
                    if clean_text:
                        row.append(left.decode() if column[len(rows)].is_valid else None)
                    rows.append(row)
            return list(zip(*rows)) if rows else [[]] * (7 + spans + clean_text)

        return search

    return append_columns(docs, text_col, COLUMNS + more, make)


def plant_periods(text: Column, key: Column) -> Column:
    """``text`` with a periodic tail in a tenth of all keys, as its words joined by blanks.

    With h the CRC-32 of the key and g = h div 10, rows with h mod 10 = 0 repeat from
    word a = g mod n on the next 1 + (n - a) div (3 + g mod 8) words.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        pick = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.when(n > 0, F.array_join(pick, " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # One lambda binds the words, so they are split once.
    tail = F.get(F.transform(F.array(words), planted), 0)
    return F.when(h % 10 == 0, tail).otherwise(text)
