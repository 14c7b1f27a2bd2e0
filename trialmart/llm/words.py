"""Words and shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

# ASCII blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\v\f\r"
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_BLANK = np.isin(np.arange(256), list(BLANKS))

PIECE = 1 << 20
_LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _random_odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(
        0, 1 << 64, n, dtype=np.uint64
    ) | np.uint64(1)


BYTE_VALUES = _random_odd(1, 256)
PLACE_FACTORS = _random_odd(2, 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def make_powers(n: int = PIECE + 2 * _LONG_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for pieces of up to ``n`` bytes."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hash_words(data: bytes, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of every blank-separated word of up to a piece of bytes.

    A word is a polynomial in its bytes: differences of running sums, brought
    back to the word's start by the inverse power.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~IS_BLANK[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * powers[0][: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers[1][starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return hashes, starts


def _cut(data: bytes, start: int) -> int:
    """End of the piece that begins at ``start``: at a blank, if there is one in reach."""
    end = start + PIECE
    if end >= len(data):
        return len(data)
    at = max(data.rfind(bytes([b]), start, end) for b in BLANKS)
    return at + 1 if at >= 0 else -1


def hash_long_text(data: bytes, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Word hashes of a text of any length, piece by piece."""
    found, start = [], 0
    while start < len(data):
        end = _cut(data, start)
        if end < 0:  # a word longer than a piece
            stops = [data.find(bytes([b]), start) for b in BLANKS]
            end = min((s for s in stops if s >= 0), default=len(data))
            found.append(np.array([xxhash.xxh64_intdigest(data[start:end])], np.uint64))
        else:
            found.append(hash_words(data[start:end], powers)[0])
        start = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def words_of_texts(
    texts: Sequence[bytes], powers: tuple[np.ndarray, np.ndarray]
) -> Iterator[tuple[int, np.ndarray]]:
    """``(index, word hashes)`` of each text, small texts hashed together."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size + len(texts[last]) + 1 <= PIECE:
            size += len(texts[last]) + 1
            last += 1
        if last == first:
            yield first, hash_long_text(texts[first], powers)
            first += 1
            continue
        group = texts[first:last]
        hashes, starts = hash_words(b" ".join(group), powers)
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        bounds = np.searchsorted(starts, offsets)
        for i in range(len(group)):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]
        first = last


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    size = min(k, len(words))
    n = len(words) - size + 1
    total = np.full(n, PLACE_FACTORS[63 - size], np.uint64)
    for j in range(size):
        total += words[j : j + n] * PLACE_FACTORS[j]
    return mix(total)
