"""Near duplicates by 64-bit SimHash, compared bit plane by bit plane.

Fingerprint: A-Z lower-cased, words between ASCII blanks, XXH64 (seed 42) of every
run of three words joined by a blank, repeats included; a bit is set if it is in
over half of the hashes. A text with fewer words is one run, one without words has
fingerprint zero.

Links: fingerprints that differ in at most ``radius`` bits.

1. Equal fingerprints are one vertex, however many documents have them.
2. ``radius + 1`` groups of bits: two linked fingerprints agree on one group at least.
   All that agree on a group are a bucket. A bucket of more than ``BUCKET_ROWS``
   is split once more in the same way on the bits it leaves free, and so on; after
   six rounds no bucket can be larger, as only 12 free bits are left.
3. Inside buckets the fingerprints are stored as bit planes, 64 fingerprints a word.
   A fingerprint is compared with a word of others at once: two planes at a time
   go through carry-save adders into counters that are bit planes themselves.
   Words in which all have exceeded the radius are abandoned every eight planes.
4. A bucket gives one link for each fingerprint that is not the first of its part,
   so dense groups send rows in proportion to their size. Components of the links
   are the result, the same as those of all close pairs.

Null text counts as empty. Rows without a word share fingerprint zero and are linked like any
others. Repeated rows and ids each keep their row; a null id names a component only
if all its members are null. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import splittable_join
from ..sources.storage import stage
from .components import components
from .frames import append_columns, schema_of, utf8
from .words import LOWER_ASCII

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
BUCKET_ROWS = 4096
_PLANES_A_CHECK = 8
_WORDS = 1 << 15
_HASHES = 1 << 14
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes) -> np.ndarray:
    words = text.translate(LOWER_ASCII).split()
    if len(words) <= SHINGLE:
        parts = [b" ".join(words)] if words else []
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
        parts = (joined[a:b] for a, b in spans)
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _HASHES):
        piece = hashes[start : start + _HASHES]
        counts += _bits(piece).sum(axis=0, dtype=np.int64)
    most = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(most.view(np.int64)[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """One row for each value, one column for each bit."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8)
    return np.unpackbits(rows, axis=1, bitorder="little")


def add_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    def make():
        def compute(column: pa.Array):
            return [[fingerprint(shingle_hashes(t)) for t in utf8(column)]]

        return compute

    return append_columns(docs, text_col, f"`{name}` long", make)


def as_hex(name: str):
    return F.lpad(F.lower(F.hex(F.col(name))), 16, "0")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values, 64 values a word."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    columns = np.ascontiguousarray(_bits(padded).T)
    return np.packbits(columns, axis=1, bitorder="little").view(np.uint64)


def _lanes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with the bits from ``low`` (0 to 63) up to ``high`` (1 or more) set."""
    above = _ALL << np.clip(low, 0, 63).astype(np.uint64)
    return above & (_ALL >> np.uint64(64) - np.clip(high, 1, 64).astype(np.uint64))


def _at_most(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is ``limit`` or less."""
    less, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if limit >> k & 1:
            less |= equal & ~counters[k]
            equal &= counters[k]
        else:
            equal &= ~counters[k]
    return less | equal


def close_pairs(
    values: np.ndarray, ends: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j < ``ends[i]`` of values that differ in ``radius`` bits or fewer."""
    planes = bit_planes(values)
    n = len(values)
    at = np.arange(n)
    first = (at + 1) // 64
    counts = np.where(ends > at + 1, (ends - 1) // 64 - first + 1, 0)
    done = np.concatenate([[0], np.cumsum(counts)])
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + _WORDS, "right")) - 1)
        own = counts[start:stop]
        query = np.repeat(at[start:stop], own)
        word = np.arange(len(query)) - np.repeat(done[start:stop] - done[start], own) + first[query]
        start = stop
        if not len(query):
            continue
        over = ~_lanes(query + 1 - 64 * word, ends[query] - 64 * word)
        counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for plane in range(0, BITS, 2):
            x, y = (
                planes[b][word] ^ np.where(values[query] >> np.uint64(b) & np.uint64(1), _ALL, np.uint64(0))
                for b in (plane, plane + 1)
            )
            one = x ^ y
            carry = (x & y) | (counters[0] & one)
            counters[0] ^= one
            for c in counters[1:]:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if (plane + 2) % _PLANES_A_CHECK == 0:
                alive = np.flatnonzero(over != _ALL)
                if len(alive) < len(over):
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(alive):
                    break
        hits = ~over & _at_most(counters, radius)
        full = np.flatnonzero(hits)
        if len(full):
            row, lane = np.nonzero(_bits(hits[full]))
            yield query[full[row]], 64 * word[full[row]] + lane


def parts_of(values: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For each value the first position of its connected part."""
    label = np.arange(len(values))
    for i, j in close_pairs(values, ends, radius):
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label = further
    return label


def split_masks(mask: int, radius: int) -> list[int]:
    """``mask`` with one of ``radius + 1`` groups of its free bits added."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    groups = np.array_split(free, radius + 1)
    return [mask | sum(1 << int(b) for b in g) for g in groups if len(g)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _dealt(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """``(mask, value, fp)``: the fingerprints in the buckets that split those of the masks.

    At most ``(radius + 1) ** 6`` masks, so their table is small.
    """
    children = [[_signed(c) for c in split_masks(m, radius)] for m in masks]
    if len(masks) == 1:
        found = rows.select(F.explode(F.array(*map(F.lit, children[0]))).alias("mask"), "fp")
    else:
        pairs = list(zip(map(_signed, masks), children))
        table = rows.sparkSession.createDataFrame(pairs, "mask long, children array<long>")
        found = rows.join(F.broadcast(table), "mask").select(F.explode("children").alias("mask"), "fp")
    return found.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """``(a, b)`` links inside buckets; a bucket is one task's, and bounded."""
    schema = schema_of("a long, b long")

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                new = np.stack([np.asarray(c) for c in batch.columns])
                rest = new if rest is None else np.concatenate([rest, new], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            mask, value, fp = rest
            borders = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            if batch is None:
                size = len(fp)
            else:  # the last bucket may go on
                size = int(borders[-1]) if len(borders) else 0
            rest, fp = rest[:, size:], np.ascontiguousarray(fp[:size])
            borders = np.append(borders[borders < size], size)
            ends = borders[np.searchsorted(borders, np.arange(size), "right")]
            label = parts_of(fp.view(np.uint64), ends, radius)
            linked = np.flatnonzero(label != np.arange(size))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[linked]), pa.array(fp[label[linked]])], names=schema.names
                )

    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(run, schema).distinct()


def _with_end(batches):
    yield from batches
    yield None


def close_fingerprints(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within the radius.

    Not every close pair is a row, but its two ends are in one component.
    """
    if not 0 <= radius < 8:
        raise ValueError("radius must be between 0 and 7")
    masks, level = [0], fingerprints.select("fp")
    links = []
    while True:
        rows = stage(_dealt(level, masks, radius), "simhash_buckets")
        masks = sorted({c for m in masks for c in split_masks(m, radius)})
        large = stage(
            rows.groupBy("mask", "value").count().where(F.col("count") > BUCKET_ROWS)
            .select(F.struct("mask", "value").alias("bucket"), F.lit(True).alias("large")),
            "simhash_large",
        )
        if large.isEmpty():
            links.append(stage(_compared(rows, radius), "simhash_links"))
            break
        told = splittable_join(rows.withColumn("bucket", F.struct("mask", "value")), large, "bucket", "left")
        small = told.where("large is null").select("mask", "value", "fp")
        links.append(stage(_compared(small, radius), "simhash_links"))
        level = told.where("large").select("mask", "fp")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS
) -> DataFrame:
    """One row per document: id, ``fingerprint`` in hex, ``component_id`` (the smallest id in it)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = stage(add_fingerprint(narrow, "text", "fp").select("id", "fp"), "simhash_documents")
    least = stage(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash_fingerprints")
    labels = components(close_fingerprints(least.select("fp"), radius), "a", "b")
    named = splittable_join(least, labels.select(F.col("vertex").alias("fp"), "label"), "fp", "left")
    named = named.select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component"))
    of_print = splittable_join(named, smallest, "label", "inner").select("fp", "component")
    return splittable_join(marked, of_print, "fp", "left").select(
        F.col("id").alias(id_col), as_hex("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )
