"""Ranked lexical search: the best documents for every query, exactly.

Terms are the runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. N counts documents with a term, L all their terms, n those of one
document, df the documents that hold a term, tf its occurrences in one. A term weighs
``w = floor(1000 ln((2N + 2) / (2df + 1)))``. With ``m = 25 + (75 n N) div L`` a document
scores the sum of ``w * ((10^9 tf) div (1000 tf + 8m))`` over the terms of the query,
repeats included.

A first pass over the documents counts N, L and df. In the second, each task turns
its documents into indexes of about ``BLOCK_POSTINGS`` postings, one after the other, and
answers all queries from each. An index has one posting list for each term and over it a
sparse table: the place of the greatest impact in every stretch of 2^j postings.
Search is best first over intervals of documents. The sum of the range maxima of
the query's terms bounds every score in an interval; the interval with the highest
bound is split at the document that holds the greatest of these maxima, which is
scored, and both rests come back with bounds of their own. Intervals below the
score of the last place so far, kept from index to index, are given up. A few
intervals are split at a time, by array operations.

Only the terms of the queries are indexed. Documents that agree in these and in
length score alike, so an index holds one entry for them with the ids that can get a
place. Queries come in blocks of at most ``max_query_bytes`` and a query, each with its
own passes; the statistics fetched are two numbers and one for each term of the block.

Null text counts as empty. A document or query without a term has no part in the results, nor
has one of score 0. Equal scores go by ascending id, null ids last. Repeated rows of
the documents are documents of their own; of repeated queries (id and text) one is
answered. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import splittable_join
from ..sources.storage import stage
from .frames import rows_from_texts, utf8
from .words import LOWER_ASCII

BLOCK_POSTINGS = 1 << 19
MAX_QUERY_BYTES = 8 << 20
SPLITS = 256
SALTS = 64
_DOCUMENTS, _TERMS = -1, -2
# Bytes of UTF-8: ASCII letters and digits and all of non-ASCII characters are kept.
_TO_TERMS = bytes(
    LOWER_ASCII[b] if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Index:
    """Postings of some documents by term, each list in order of document.

    ``docs``: for each the length, its term numbers and their counts.
    """

    def __init__(self, docs: Sequence[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = np.array([len(t) for _, t, _ in docs])
        term = np.concatenate([t for _, t, _ in docs])
        tf = np.concatenate([c for _, _, c in docs])
        norm = np.array([8 * (25 + 75 * n * n_docs // n_terms) for n, _, _ in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(term * len(docs) + doc)
        self.n_docs = len(docs)
        self.doc, term = doc[order], term[order]
        self.keys = term * len(docs) + self.doc
        impact = weights[term] * ((1_000_000_000 * tf[order]) // (1000 * tf[order] + norm[self.doc]))
        self.impact = np.append(impact, 0)
        bounds = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.lists = dict(zip(term[bounds].tolist(), zip(bounds.tolist(), [*bounds[1:].tolist(), len(term)])))
        longest = int(np.diff(np.append(bounds, len(term))).max())
        self.log = np.zeros(longest + 1, np.int64)
        for j in range(1, longest.bit_length()):
            self.log[1 << j :] = j
        self.tables = self._tables(longest)

    def _tables(self, longest: int) -> np.ndarray:
        """Row j: where the greatest impact of the 2^j postings from each place on is."""
        levels = longest.bit_length()
        tables = np.empty((levels, len(self.doc)), np.int32)
        tables[0] = np.arange(len(self.doc))
        for j in range(1, levels):
            half = 1 << (j - 1)
            one, two = tables[j - 1][:-half], tables[j - 1][half:]
            tables[j] = tables[j - 1]
            tables[j][:-half] = np.where(self.impact[one] >= self.impact[two], one, two)
        return tables

    def greatest(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the greatest impact from ``begin`` up to ``end``; the place after all for none."""
        size = end - begin
        level = self.log[size]
        last = len(self.doc) - 1
        one = self.tables[level, np.minimum(begin, last)]
        two = self.tables[level, np.clip(end - (1 << level), 0, last)]
        best = np.where(self.impact[one] >= self.impact[two], one, two)
        return np.where(size > 0, best, last + 1)

    def search(self, query: dict[int, int], best: Best) -> None:
        """Offer all documents that can get a place, best bounds first."""
        terms = [t for t in query if t in self.lists]
        if not terms:
            return
        times = np.array([query[t] for t in terms])
        base = np.array(terms) * self.n_docs
        ranges = np.array([self.lists[t] for t in terms])
        begin, end = ranges[None, :, 0], ranges[None, :, 1]

        def bounded(begin: np.ndarray, end: np.ndarray):
            """The intervals worth keeping: postings, bound, document to split at."""
            top = self.greatest(begin, end)
            value = self.impact[top] * times
            bound = value.sum(axis=1)
            keep = np.flatnonzero(bound >= best.least)
            top, value = top[keep], value[keep]
            split = self.doc[top[np.arange(len(keep)), value.argmax(axis=1)]]
            return begin[keep], end[keep], bound[keep], split

        waiting = bounded(begin, end)
        size = 1
        while len(waiting[2]):
            worth = np.flatnonzero(waiting[2] >= best.least)
            if not len(worth):
                return
            if len(worth) > size:
                first = np.argpartition(-waiting[2][worth], size - 1)
                now, later = worth[first[:size]], worth[first[size:]]
            else:
                now, later = worth, worth[:0]
            begin, end, _, split = (x[now] for x in waiting)
            at = np.searchsorted(self.keys, base + split[:, None])
            hit = at < end
            hit &= self.doc[np.where(hit, at, 0)] == split[:, None]
            scores = (self.impact[np.where(hit, at, -1)] * times).sum(axis=1)
            for i in np.flatnonzero(scores >= best.least).tolist():
                best.offer(int(scores[i]), int(split[i]))
            rest = bounded(np.concatenate([begin, at + hit]), np.concatenate([at, end]))
            waiting = tuple(np.concatenate([x[later], y]) for x, y in zip(waiting, rest))
            size = min(2 * size, SPLITS)


class Best:
    """The first ``k`` of one query so far. ``ids``: of each entry of the index at hand."""

    def __init__(self, k: int):
        self.k, self.rows, self.least, self.ids = k, [], 1, []

    def offer(self, score: int, doc: int) -> None:
        for i in self.ids[doc]:
            insort(self.rows, (-score, i is None, i if i is not None else 0))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


def _numbers(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    terms = np.fromiter(counts.keys(), np.int64, len(counts))
    order = np.argsort(terms)
    return terms[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


def statistics(docs: DataFrame, text_col: str, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """df by term number, and under negative numbers N and L."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        get, sums = shared.value.get, np.zeros(len(shared.value), np.int64)
        totals = [0, 0]

        def run(batch: pa.RecordBatch | None):
            if batch is None:
                used = np.flatnonzero(sums)
                return [_DOCUMENTS, _TERMS, *used.tolist()], [*totals, *sums[used].tolist()]
            for text in utf8(batch.column(0)):
                words = terms_of(text)
                if words:
                    totals[0] += 1
                    totals[1] += len(words)
                    held = set(map(get, words))
                    held.discard(None)
                    sums[list(held)] += 1
            return None

        return run

    counted = rows_from_texts(docs, [text_col], "term long, n long", make)
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _block_results(
    docs: DataFrame, id_col: str, text_col: str, queries: list[dict[int, int]],
    vocabulary: dict[bytes, int], k: int,
) -> DataFrame | None:
    """``(query, id, score)``: the first ``k`` of every task."""
    found = statistics(docs, text_col, vocabulary)
    n_docs, n_terms = found.get(_DOCUMENTS, 0), found.get(_TERMS, 0)
    if not n_docs:
        return None
    weights = np.array([term_weight(n_docs, found.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights, queries))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        words_of, own_weights, own_queries = shared.value
        get = words_of.get
        best = [Best(k) for _ in own_queries]
        block, size = {}, 0  # (length, terms, counts) -> ids

        def answer():
            nonlocal block, size
            if block:
                # By length, so that long documents with their low impacts lie together.
                entries = sorted(block, key=lambda e: e[0])
                docs_in = [(n, np.frombuffer(t, np.int64), np.frombuffer(c, np.int64)) for n, t, c in entries]
                index = Index(docs_in, own_weights, n_docs, n_terms)
                ids = [sorted(block[e], key=lambda i: (i is None, i if i is not None else 0))[:k] for e in entries]
                for query, first in zip(own_queries, best):
                    first.ids = ids
                    index.search(query, first)
            block, size = {}, 0

        def run(batch: pa.RecordBatch | None):
            nonlocal size
            if batch is None:
                answer()
                rows = [
                    (q, None if null else i, -score)
                    for q, first in enumerate(best) for score, null, i in first.rows
                ]
                return list(zip(*rows)) if rows else [[], [], []]
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = terms_of(text)
                counts = Counter(map(get, words))
                counts.pop(None, None)
                if not counts:
                    continue
                terms, tfs = _numbers(counts)
                ids = block.setdefault((len(words), terms.tobytes(), tfs.tobytes()), [])
                if not ids:
                    size += len(terms)
                ids.append(i)
                if len(ids) > 4 * k + 1000:
                    ids.sort(key=lambda x: (x is None, x if x is not None else 0))
                    del ids[k:]
                if size >= BLOCK_POSTINGS:
                    answer()
            return None

        return run

    return rows_from_texts(docs, [id_col, text_col], f"query long, id {kind}, score long", make)


def _first(rows: DataFrame, keys: Sequence[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_col: str = "text",
    k: int = 10,
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """``(query id, rank, id, score)``: the ``k`` best documents of every query."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id_col}`").alias("query_id"), F.col(f"`{query_col}`").alias("text"))
    asked = asked.where("text is not null").distinct()
    texts = stage(asked.select("text").distinct(), "search_texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // max_query_bytes))
    block_of = F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    answers = None
    for block in range(n_blocks):
        own = [r["text"] for r in texts.where(block_of == block).collect()]
        vocabulary: dict[bytes, int] = {}
        numbered = [
            dict(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text.encode())))
            for text in own
        ]
        found = _block_results(narrow, "id", "text", numbered, vocabulary, k) if vocabulary else None
        if found is None:
            continue
        # Every task sends k rows at most; salts keep those of a query out of one task.
        salted = _first(found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), ["query", "salt"], k, "rank")
        ranked = _first(salted.drop("rank", "salt"), ["query"], k, "rank")
        names = docs.sparkSession.createDataFrame(list(enumerate(own)), "query long, text string")
        made = stage(ranked.join(names, "query").select("text", "rank", "id", "score"), "search_answers")
        answers = made if answers is None else answers.unionByName(made)
    if answers is None:
        answers = _no_answers(narrow)
    # Many ids may ask the same text.
    return splittable_join(asked, answers, "text", "inner").select(
        F.col("query_id").alias(query_id_col), "rank", F.col("id").alias(id_col), "score"
    )


def _no_answers(docs: DataFrame) -> DataFrame:
    empty = docs.where(F.lit(False))
    return empty.select("text", F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
