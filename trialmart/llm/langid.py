"""Languages of documents, mixtures included.

Each language has probabilities of letter trigrams, learned from labelled texts.
A document is a mixture: every word comes from one language, and
expectation-maximisation estimates the proportions from the words' likelihoods. The
set of languages grows one at a time while the penalised likelihood does.

Null texts and texts without a letter have the language ``und`` and score 0. Without
labelled text nothing can be learned and all are ``und``. Equal proportions go to
the language first in the alphabet. Texts are read whole; columns of the input
with the names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import append_columns, rows_from_texts

UNDETERMINED = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.05
MAX_LANGUAGES = 512
_PIECE = 1 << 20
_GROUP = 1 << 17  # characters that are looked at together, a longer text apart
_TEXTS = 500
_FLOOR = -30.0  # no single word counts for more than this
_TURNS = 12


def held_out(id_col: Column) -> Column:
    """The documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts, cut between words unless a word is longer than a part."""
    start = 0
    while start < len(text):
        end = min(start + _PIECE, len(text))
        cut = end
        while end < len(text) and cut > start and text[cut - 1].isalpha():
            cut -= 1
        end = cut if cut > start else end
        yield text[start:end]
        start = end


def trigrams(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, first letter of each word, its place.

    Anything but a letter counts as a blank.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.full(len(codes) + 2, 32, np.uint64)
    is_letter = letters[codes]
    padded[1:-1] = np.where(is_letter, codes, 32)
    at = np.flatnonzero(is_letter)
    h = padded[at] * np.uint64(0x9E3779B97F4A7C15)
    h += padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += padded[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    buckets = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return buckets, starts, at[starts]


def trigram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, bucket, n)`` over whole texts, summed up inside each task first."""

    def make():
        letters = letter_table()
        sums: dict[str, np.ndarray] = {}

        def count(batch: pa.RecordBatch | None):
            if batch is None:
                langs, buckets, numbers = [], [], []
                for lang, total in sums.items():
                    used = np.flatnonzero(total)
                    langs += [lang] * len(used)
                    buckets += used.tolist()
                    numbers += total[used].tolist()
                return langs, buckets, numbers
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                by_lang: dict[str, list[str]] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for group in _groups(texts):
                        for piece in _pieces("\n".join(texts[i] for i in group).lower()):
                            total += np.bincount(trigrams(piece, letters)[0], minlength=BUCKETS)
            pa.default_memory_pool().release_unused()
            return None

        return count

    labelled = docs.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    partial = rows_from_texts(
        labelled, [text_col, lang_col], "lang string, bucket int, n long", make
    )
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities, one row per trigram bucket.

    At most ``BUCKETS`` rows per language reach the driver, and at most
    ``MAX_LANGUAGES`` languages are allowed, however large the corpus.
    """
    most = BUCKETS * MAX_LANGUAGES
    counts = trigram_counts(docs, text_col, lang_col).limit(most + 1).toPandas()
    langs = sorted(counts["lang"].unique())
    if len(langs) > MAX_LANGUAGES or len(counts) > most:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((BUCKETS, len(langs)))
    where = {lang: i for i, lang in enumerate(langs)}
    table[counts["bucket"].to_numpy(int), counts["lang"].map(where).to_numpy(int)] = counts["n"]
    table += SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def word_likelihoods(
    text: str, model: np.ndarray, letters: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Relative likelihood of every word under every language, and the words' places."""
    rows, places, done = [], [], 0
    for piece in _pieces(text):
        buckets, starts, at = trigrams(piece, letters)
        if len(starts):
            logs = np.add.reduceat(model[buckets], starts, axis=0)
            logs -= logs.max(axis=1, keepdims=True)
            rows.append(np.exp(np.maximum(logs, _FLOOR)))
            places.append(at + done)
        done += len(piece)
    if not rows:
        return np.zeros((0, model.shape[1]), np.float32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(places)


def mixtures(
    likelihoods: np.ndarray, starts: np.ndarray, penalty: float, max_set: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Language sets (-1: none) and proportions of documents that all have a word.

    ``starts`` are the first words of the documents. A set grows by the language
    with the steepest likelihood; it is accepted if that gains more than
    ``penalty / 2 * log(words)``, the BIC price for ``penalty`` = 1. Sets end there, or
    at ``max_set`` languages if that is given.
    """
    n_docs, n_langs = len(starts), likelihoods.shape[1]
    n = np.diff(np.append(starts, len(likelihoods)))
    single = np.add.reduceat(np.log(likelihoods), starts, axis=0)
    chosen = single.argmax(axis=1)[:, None]
    shares = np.ones((n_docs, 1))
    best = single.max(axis=1)
    docs, rows, first = np.arange(n_docs), likelihoods, starts
    for k in range(1, min(max_set or n_langs, n_langs)):
        size = n[docs]
        doc = np.repeat(np.arange(len(docs)), size)
        line = np.arange(len(rows))[:, None]
        held = rows[line, chosen[docs][doc, :k]]
        density = (held * shares[docs][doc, :k]).sum(axis=1)
        slope = np.add.reduceat(rows / density[:, None], first, axis=0)
        np.put_along_axis(slope, chosen[docs][:, :k], -np.inf, axis=1)
        new = slope.argmax(axis=1)
        held = np.column_stack([held, rows[line[:, 0], new[doc]]])
        share = np.column_stack([shares[docs][:, :k] * k / (k + 1), np.full(len(docs), 1 / (k + 1))])
        for _ in range(_TURNS):
            joint = held * share[doc]
            joint /= joint.sum(axis=1, keepdims=True)
            share = np.add.reduceat(joint, first, axis=0) / size[:, None]
        value = np.add.reduceat(np.log((held * share[doc]).sum(axis=1)), first)
        won = value - best[docs] > penalty / 2 * np.log(np.maximum(size, 2))
        if not won.any():
            break
        grown = docs[won]
        chosen = np.column_stack([chosen, np.full(n_docs, -1)])
        shares = np.column_stack([shares, np.zeros(n_docs)])
        chosen[grown, k] = new[won]
        shares[grown, : k + 1] = share[won]
        best[grown] = value[won]
        rows = rows[won[doc]]
        docs = grown
        first = np.concatenate([[0], np.cumsum(n[docs])[:-1]])
    return chosen, shares


def predict(
    docs: DataFrame,
    langs: list[str],
    model: np.ndarray,
    text_col: str = "text",
    *,
    penalty: float = 2.0,
    max_set: int | None = None,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion) and ``lang_mix``.

    ``lang_mix`` lists all languages found, largest first, as ``en:0.812,fr:0.188``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return labeller(langs, shared.value, penalty, max_set)

    return append_columns(docs, text_col, "lang_pred string, score double, lang_mix string", make)


def labeller(langs: list[str], table: np.ndarray, penalty: float = 2.0, max_set: int | None = None):
    """Function from a column of texts to prediction, score and mixture of each.

    Few texts are looked at together, so what it needs does not grow with the batch; a
    Python worker goes on to other tasks with the memory it holds.
    """
    letters = letter_table()

    def label(column: pa.Array):
        pred, score, mix = [], [], []
        for start in range(0, len(column), _TEXTS):
            texts = [(t or "").lower() for t in column.slice(start, _TEXTS).to_pylist()]
            for values, found in zip((pred, score, mix), label_texts(texts)):
                values += found
        pa.default_memory_pool().release_unused()
        return pred, score, mix

    def label_texts(texts: list[str]):
        pred, score, mix = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
        for group in _groups(texts) if langs else ():
            joined = "\n".join(texts[i] for i in group)
            rows, places = word_likelihoods(joined, table, letters)
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            bounds = np.searchsorted(places, ends)
            full = np.flatnonzero(np.diff(bounds, prepend=0))
            if not len(full):
                continue
            starts = np.concatenate([[0], bounds[:-1]])[full]
            sets, shares = mixtures(rows.astype(np.float64), starts, penalty, max_set)
            for j, which in enumerate(full):
                found = [
                    (-round(float(s), 6), langs[l]) for l, s in zip(sets[j], shares[j]) if l >= 0
                ]
                found.sort()
                i = group[which]
                pred[i], score[i] = found[0][1], min(1.0, -found[0][0])
                mix[i] = ",".join(f"{name}:{-s:.3f}" for s, name in found)
        return pred, score, mix

    return label


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Texts to be handled together: some characters at a time."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if group and size + len(text) > _GROUP:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    if group:
        yield group


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the labelled documents that are not held out, then label them all."""
    learned = docs.where(~held_out(F.col(f"`{id_col}`")))
    langs, model = learn(learned, text_col, lang_col)
    return predict(docs, langs, model, text_col)
