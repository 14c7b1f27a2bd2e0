"""Training documents that hold passages of a benchmark, edited or not.

Passages are aligned with items by Smith-Waterman over words; the score is the share
of the best possible one. A verbatim or nearly verbatim excerpt of 13 words counts
however long the item is; segments of long items overlap by half. Items of fewer than
``min_words`` words are found only with all their words in a row.

Seeds are n-grams of the items. Of an alignment with ``m`` matches and ``e`` edits the
score is ``2 m - e``, and at least ``m - 1 - e / 2`` neighbouring matches have at most
one edit between them: such two words are one or two places apart in the item and in
the document. So an alignment at the threshold holds such pairs from at least ``F``
places of the item, and the item's pairs may be left out at any ``F - 1`` places. The
strict score of an excerpt, ``2 m - 4 e``, leaves at least ``excerpt - 2`` runs of three
matching words, of which all but one may be left out likewise. What n-grams occur how
often is counted over all documents: the most frequent places go, n-grams that do not
occur go, and the rare rest still meets every passage. No edit hides one.

The rare seeds in each document join it to the segments that own them, by a shuffle of
numbers; only documents with such candidates move, to be aligned. The benchmark is
never collected or broadcast. What travels to the tasks is a bit table over the seeds of
at most 16 MB (``MAX_BITS``), which spares rows that cannot match; a benchmark of very
many seeds fills it, so that it spares less, with the same result. A document with many
candidates is aligned in parts of ``PART`` segments.

Null and empty texts hold nothing; null or empty items have nothing to leak. Of items
with equal words the smallest id is reported, null if they have none. Repeated documents
are judged each for itself. Columns may have any names; one called ``leaks`` is replaced
by ``with_leaks``. Of equally good places of an item the first in the document is given.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import splittable_join
from ..sources.storage import stage
from .frames import append_columns, nest, rows_from_texts
from .words import PLACE_FACTORS, make_powers, mix, words_of_texts

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANKED = bytes(32 if chr(b) in PUNCTUATION else b for b in range(256))
REACH = 2
SEGMENT = 512
STEP = 256
STRICT = 4  # edits of an excerpt cost so many times as much
MATCH, MISMATCH, GAP = 2, -1, 1
PAIRS, SINGLE, RUNS = 0, 1, 2  # kinds of seeds
LONGEST_RUN = 3
MAX_BITS = 27
PART = 64
_WINDOW = 1 << 14
_FLUSH = 1 << 20
BATCH_ROWS = 1000  # texts that go to Python at once


def plain_text(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKED)


def align(item: np.ndarray, passage: np.ndarray, edit: int = 1) -> tuple[int, int]:
    """Best local alignment score and the end of it in the passage.

    ``edit`` multiplies the cost of mismatches and gaps.

    A gap costs the same for each word, so the gaps along a row are one running
    maximum.
    """
    mismatch, gap = MISMATCH * edit, GAP * edit
    ramp = gap * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        here = np.zeros_like(above)
        np.maximum(above[:-1] + np.where(passage == word, MATCH, mismatch), 0, out=here[1:])
        here = np.maximum(here, above - gap)
        here = np.maximum.accumulate(here + ramp) - ramp
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def seed_hashes(words: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of all pairs up to ``REACH`` apart, or of single words."""
    if alone:
        return mix(words + PLACE_FACTORS[2]), np.arange(len(words))
    first = words * PLACE_FACTORS[0]
    second = words * PLACE_FACTORS[1]
    found = [mix(first[:-d] + second[d:]) for d in range(1, REACH + 1) if d < len(words)]
    at = [np.arange(len(f)) for f in found]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(at)) if found else none


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return words[:0]
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * PLACE_FACTORS[3 + j]
    return mix(total)


class Rules:
    """What counts as a leak, and how many seeds of a segment that needs."""

    def __init__(self, threshold: float, min_words: int, excerpt_words: int):
        self.threshold, self.min_words = threshold, min_words
        self.excerpt_words = excerpt_words
        self.excerpt = MATCH * excerpt_words
        self.run = max(1, min(LONGEST_RUN, excerpt_words))

    def needed(self, n: int) -> float:
        return (self.threshold if n >= self.min_words else 1.0) * MATCH * n

    def least(self, n: int) -> float:
        return min(self.needed(n), self.excerpt)

    def alone(self, n: int) -> bool:
        """A single matching word may be enough, so there is no pair to rely on."""
        return self.least(n) <= MATCH

    @staticmethod
    def pairs_within(score: float) -> int:
        """Places of pairs that an alignment of this score holds at least."""
        return max(int(np.ceil(score / MATCH - 1 - 1e-9)), 1)

    def seeds(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(kind, place, hash, spare)``: ``spare`` places of the kind may be left out."""
        n, found = len(words), []

        def add(kind: int, hashes: np.ndarray, places: np.ndarray, spare: int) -> None:
            found.extend(
                (kind, at, h, spare) for at, h in zip(places.tolist(), hashes.view(np.int64).tolist())
            )

        if self.alone(n):
            add(SINGLE, *seed_hashes(words, True), 0)
            return found
        add(PAIRS, *seed_hashes(words, False), self.pairs_within(self.needed(n)) - 1)
        if self.excerpt < self.needed(n):
            runs = run_hashes(words, self.run)
            add(RUNS, runs, np.arange(len(runs)), self.excerpt_words - self.run)
        return found

    def hashes(self, words: np.ndarray, kinds: Sequence[int]) -> np.ndarray:
        """All n-grams of a document that may be seeds of these kinds."""
        found = [words[:0]]
        if PAIRS in kinds:
            found.append(seed_hashes(words, False)[0])
        if SINGLE in kinds:
            found.append(seed_hashes(words, True)[0])
        if RUNS in kinds:
            found.append(run_hashes(words, self.run))
        return np.concatenate(found)


def segments_of(words: np.ndarray) -> list[np.ndarray]:
    """An item as it is, or in segments that overlap; the last is filled up from before."""
    starts = range(0, max(len(words) - SEGMENT + STEP, 1), STEP)
    parts = [words[start : start + SEGMENT] for start in starts]
    if len(parts) > 1 and len(parts[-1]) < SEGMENT:
        parts[-1] = words[-SEGMENT:]
    return [p for p in parts if len(p)]


def build_sieve(seeds: DataFrame) -> np.ndarray:
    """Bit table over the leading bits of ``hash``, some 1024 places per seed up to its limit."""
    bits = min(max(16, seeds.count().bit_length() + 10), MAX_BITS)
    slot = F.shiftrightunsigned("hash", 64 - bits)
    filled = (
        seeds.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    sieve = np.zeros(1 << (bits - 6), np.uint64)
    sieve[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return sieve


def sifted(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """The hashes that may be seeds."""
    slot = hashes >> np.uint64(64 - 6 - len(sieve).bit_length() + 1)
    word = sieve[(slot >> np.uint64(6)).astype(np.int64)]
    return hashes[(word >> (slot & np.uint64(63))) & np.uint64(1) == 1]


class Segment:
    """A segment to be aligned: its seeds, and bounds on where an alignment lies.

    An alignment has at most as many edits as twice its matches less the score, so it
    spans at most three segment lengths less the needed score.
    """

    def __init__(self, words: np.ndarray, rules: Rules):
        n = len(words)
        self.words, self.needed, self.least = words, rules.needed(n), rules.least(n)
        self.alone = rules.alone(n)
        self.fewest = rules.pairs_within(self.least)
        self.span = int(np.ceil(3 * n - self.least))
        self.seeds = np.unique(seed_hashes(words, self.alone)[0])

    def stretches(self, hashes: np.ndarray, places: np.ndarray) -> list[list[int]]:
        """``[low, high]`` where enough seeds lie together; overlapping ones are joined."""
        if not len(hashes):
            return []
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        place = np.unique(places[self.seeds[at] == hashes])
        if len(place) < self.fewest:
            return []
        first, last = place[: len(place) - self.fewest + 1], place[self.fewest - 1 :]
        found: list[list[int]] = []
        for k in np.flatnonzero(last - first <= self.span).tolist():
            low, high = int(last[k]) - self.span, int(first[k]) + self.span + 1
            if found and low < found[-1][1]:
                found[-1][1] = max(found[-1][1], high)
            else:
                found.append([low, high])
        return found


def passages(words: np.ndarray, segments: Sequence[Segment]) -> list[tuple[int, int, int]]:
    """``(segment, low, high)``: stretches of the document that may reach the threshold.

    Long documents are looked at in windows that overlap by the widest span.
    """
    found, widest = [], max(s.span for s in segments)
    for start in range(0, max(1, len(words) - widest), _WINDOW):
        part = words[start : start + _WINDOW + widest]
        pairs = seed_hashes(part, False)
        single = seed_hashes(part, True) if any(s.alone for s in segments) else pairs
        for i, s in enumerate(segments):
            for low, high in s.stretches(*(single if s.alone else pairs)):
                found.append((i, max(0, start + low), min(len(words), start + high)))
    return found


def _judge(
    item: np.ndarray, passage: np.ndarray, needed: float, excerpt: int
) -> tuple[int, int, int] | None:
    """Score, start and end in the passage if it holds enough of the item."""
    edit = 1
    score, end = align(item, passage)
    if score < needed:
        # A strict score is never above the other one.
        edit = STRICT
        score, end = align(item, passage, edit) if score >= excerpt else (score, end)
        if score < excerpt:
            return None
    return score, end - align(item[::-1], passage[:end][::-1], edit)[1], end


def leaks_of(
    words: np.ndarray, segments: Sequence[tuple[int, int, Segment]], excerpt: int, cache: dict
) -> list[tuple[int, float, int, int]]:
    """``(item, score, first word, last word)`` of the items that a document holds.

    ``segments`` are ``(number, item, segment)``; several segments of an item may be there.
    """
    best: dict[int, tuple] = {}
    for i, low, high in passages(words, [s for _, _, s in segments]):
        number, item, segment = segments[i]
        passage = words[low:high]
        if MATCH * int(np.isin(segment.words, passage).sum()) < segment.least:
            continue
        key = (number, passage.tobytes())
        if key not in cache:
            if len(cache) > 2000:
                cache.clear()
            cache[key] = _judge(segment.words, passage, segment.needed, excerpt)
        if cache[key] is not None:
            score, start, end = cache[key]
            found = (-score / (MATCH * len(segment.words)), low + start, low + end - 1)
            best[item] = min(best.get(item, found), found)
    return [(item, -s, a, b) for item, (s, a, b) in sorted(best.items())]


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_no, item, segments``: one row per sequence of words, the smallest id of each."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("_text"))

    def make():
        powers = make_powers()

        def hashed(column: pa.Array):
            texts = [plain_text(t) for t in column.to_pylist()]
            return [[words.tobytes() for _, words in words_of_texts(texts, powers)]]

        return hashed

    def cut():
        def parts(column: pa.Array):
            words = (np.frombuffer(w, np.uint64) for w in column.to_pylist())
            return [[[p.tobytes() for p in segments_of(w)] for w in words]]

        return parts

    words = append_columns(items, "_text", "words binary", make).select("item", "words")
    folded = words.where(F.octet_length("words") > 0).groupBy("words").agg(F.min("item").alias("item"))
    folded = folded.withColumn("item_no", F.monotonically_increasing_id())
    return append_columns(folded, "words", "segments array<binary>", cut).drop("words")


def segment_seeds(segments: DataFrame, rules: Rules) -> DataFrame:
    """``s, kind, place, hash, spare``: every seed of every segment."""
    names = ("kind", "place", "hash", "spare")

    def make():
        def seeds(column: pa.Array):
            found = (rules.seeds(np.frombuffer(w, np.uint64)) for w in column.to_pylist())
            return [[[dict(zip(names, row)) for row in rows] for rows in found]]

        return seeds

    ddl = "seeds array<struct<kind:int,place:int,hash:bigint,spare:int>>"
    own = append_columns(segments.select("s", "words"), "words", ddl, make)
    return own.select("s", F.inline("seeds"))


def count_ngrams(docs: DataFrame, rules: Rules, kinds: Sequence[int], sieve: np.ndarray) -> DataFrame:
    """``hash, n``: how often n-grams that may be seeds occur in the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def make():
        powers, held = make_powers(), []

        def counted():
            found, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return [found.view(np.int64), n]

        def compute(batch: pa.RecordBatch | None):
            if batch is None:
                return counted()
            texts = [plain_text(t) for t in batch.column(0).to_pylist()]
            for _, words in words_of_texts(texts, powers):
                held.append(sifted(rules.hashes(words, kinds), shared.value))
            return counted() if sum(map(len, held)) > _FLUSH else None

        return compute

    partial = rows_from_texts(docs, ["text"], "hash bigint, n bigint", make)
    return partial.groupBy("hash").agg(F.sum("n").alias("n"))


def rare_seeds(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """``hash, s``: seeds that occur, without the most frequent places a segment can spare."""
    known = splittable_join(seeds, counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    places = known.groupBy("s", "kind", "place").agg(
        F.sum("n").alias("n"),
        F.first("spare").alias("spare"),
        F.collect_set(F.when(F.col("n") > 0, F.col("hash"))).alias("hashes"),
    )
    # At most a segment's places, a few hundred rows.
    order = Window.partitionBy("s", "kind").orderBy(F.desc("n"), "place")
    kept = places.withColumn("rank", F.row_number().over(order)).where("rank > spare")
    return kept.select(F.explode("hashes").alias("hash"), "s").distinct()


def _with_hits(
    rows: DataFrame, column: str, at: int | None, rules: Rules, kinds: Sequence[int], sieve: np.ndarray
) -> DataFrame:
    """Documents with ``hits``, their n-grams that may be rare seeds.

    The text is ``column``, or its field number ``at``: it goes to Python once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sieve)

    def make():
        powers = make_powers()

        def search(column: pa.Array):
            found = [[] for _ in range(len(column))]
            texts = column if at is None else column.flatten()[at]
            texts = [plain_text(t) for t in texts.to_pylist()]
            for i, words in words_of_texts(texts, powers):
                found[i] = np.unique(sifted(rules.hashes(words, kinds), shared.value)).view(np.int64)
            return [found]

        return search

    return append_columns(rows, column, "hits array<bigint>", make)


def _align_all(work: DataFrame, rules: Rules) -> DataFrame:
    """``n, item_no, low, first_word, last_word`` from rows of a text and candidate segments.

    ``low`` is the score below zero, so that the smallest row of an item is its best.
    """
    def make():
        powers, cache, known = make_powers(), {}, {}

        def segment(number: int, words: bytes) -> Segment:
            if number not in known:
                if len(known) > 2000:
                    known.clear()
                known[number] = Segment(np.frombuffer(words, np.uint64), rules)
            return known[number]

        def compute(batch: pa.RecordBatch | None):
            if batch is None:
                return None
            numbers, texts, owners = (c.to_pylist() for c in batch.columns)
            out = [[], [], [], [], []]
            for i, words in words_of_texts([plain_text(t) for t in texts], powers):
                segments = [(o["s"], o["item_no"], segment(o["s"], o["words"])) for o in owners[i]]
                for item, score, first, last in leaks_of(words, segments, rules.excerpt, cache):
                    for column, value in zip(out, (numbers[i], item, -score, first, last)):
                        column.append(value)
            return out

        return compute

    ddl = "n bigint, item_no bigint, low double, first_word int, last_word int"
    return rows_from_texts(work, ["n", "text", "owners"], ddl, make)


def _search(
    rows: DataFrame,
    benchmark: DataFrame,
    item_col: str,
    item_text_col: str,
    rules: Rules,
    whole_text: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The staged documents, numbered ``n``, and ``n, item_id, score, first_word, last_word``.

    With ``whole_text``, all are staged and this is the text in their ``row``; otherwise
    only documents with a hit are, and the text is ``text``. Each text is held once and
    goes to Python with few others.
    """
    keep_all = whole_text is not None
    text, column, at = F.col("text"), "text", None
    if keep_all:
        fields = rows.schema["row"].dataType.names
        exact = whole_text if whole_text in fields else next(f for f in fields if f.lower() == whole_text.lower())
        text, column, at = F.col("row").getField(exact), "row", fields.index(exact)
    items = stage(benchmark_items(benchmark, item_col, item_text_col), "benchmark_items")
    parts = items.select("item_no", F.explode("segments").alias("words"))
    segments = stage(parts.withColumn("s", F.monotonically_increasing_id()), "benchmark_segments")
    seeds = stage(segment_seeds(segments, rules), "benchmark_seeds")
    kinds = [r["kind"] for r in seeds.select("kind").distinct().collect()]
    counts = count_ngrams(rows.select(text.alias("text")), rules, kinds, build_sieve(seeds))
    rare = stage(rare_seeds(seeds, counts), "benchmark_rare_seeds", BATCH_ROWS)

    marked = _with_hits(rows, column, at, rules, kinds, build_sieve(rare))
    if not keep_all:
        marked = marked.where(F.size("hits") > 0)
    marked = stage(marked.withColumn("n", F.monotonically_increasing_id()), "documents_with_hits", BATCH_ROWS)

    hits = marked.select("n", F.explode("hits").alias("hash"))
    candidates = splittable_join(hits, rare, "hash", "inner").select("n", "s").distinct()
    at = F.row_number().over(Window.partitionBy("n").orderBy("s"))
    candidates = candidates.withColumn("part", F.floor((at - 1) / PART))
    owners = splittable_join(candidates, segments, "s", "inner")
    owners = owners.groupBy("n", "part").agg(F.collect_list(F.struct("s", "item_no", "words")).alias("owners"))
    texts = marked.where(F.size("hits") > 0).select("n", text.alias("text"))
    work = splittable_join(owners, texts, "n", "inner")
    best = _align_all(work, rules).groupBy("n", "item_no").agg(
        F.min(F.struct("low", "first_word", "last_word")).alias("best")
    )
    found = splittable_join(best, items.select("item_no", F.col("item").alias("item_id")), "item_no", "inner")
    leaks = found.select("n", "item_id", (-F.col("best.low")).alias("score"), "best.first_word", "best.last_word")
    # What has moved goes before the documents are moved again.
    return marked, stage(leaks, "benchmark_leaks", BATCH_ROWS)


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    min_words: int = 5,
    excerpt_words: int = 13,
) -> DataFrame:
    """``docs`` with ``leaks``: the items found, by id, with score and word positions.

    An item is found by ``threshold`` of the best score of the whole of it (long items:
    of a segment; items of fewer than ``min_words`` words: of all words in a row), or by
    a passage worth ``excerpt_words`` words without edits, each edit taking off two
    words. ``score`` is the share of the best score in all cases.
    """
    rules = Rules(threshold, min_words, excerpt_words)
    marked, leaks = _search(nest(docs), benchmark, item_col, item_text_col, rules, text_col)
    own = F.struct("item_id", "score", "first_word", "last_word")
    lists = leaks.groupBy("n").agg(F.sort_array(F.collect_list(own)).alias("leaks"))
    none = F.array().cast(lists.schema["leaks"].dataType)
    some = marked.where(F.size("hits") > 0).join(lists, "n", "left")
    rest = marked.where(F.size("hits") == 0)
    both = some.select("row", F.coalesce("leaks", none).alias("leaks")).unionByName(
        rest.select("row", none.alias("leaks"))
    )
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "leaks"]
    return both.select(*kept, "leaks")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    min_words: int = 5,
    excerpt_words: int = 13,
) -> DataFrame:
    """One row per document and item found in it; clean documents have none."""
    rules = Rules(threshold, min_words, excerpt_words)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked, leaks = _search(narrow, benchmark, item_col, item_text_col, rules)
    found = leaks.join(marked.select("n", "id"), "n")
    return found.select(F.col("id").alias(id_col), "item_id", "score", "first_word", "last_word")


def drop_leaked(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    min_words: int = 5,
    excerpt_words: int = 13,
) -> DataFrame:
    """The documents that hold no item, unchanged."""
    rules = Rules(threshold, min_words, excerpt_words)
    marked, leaks = _search(nest(docs), benchmark, item_col, item_text_col, rules, text_col)
    some = marked.where(F.size("hits") > 0).join(leaks.select("n").distinct(), "n", "left_anti")
    rest = marked.where(F.size("hits") == 0)
    return some.select("row.*").unionByName(rest.select("row.*"))
