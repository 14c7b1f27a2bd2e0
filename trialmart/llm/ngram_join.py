"""Exact join of documents whose word shingle sets have Jaccard 0.75 or more.

1. Every text becomes a set of shingle hashes. Documents with equal sets are one
   *class*, so copies meet nothing twice. Sets take more room than the texts, so they are
   made again where they are used; only those of classes with a block are written.
2. Classes that can be similar share one of their rarest shingles (the prefix of the
   set in a global order by rough frequency, from a counting sketch of fixed size). In
   the rarest one they share all that they have in common is still to come, so its place
   in each set bounds the size of the other: the *reach* of a class.
   Classes with a common prefix shingle form a block; shingles that lie alone are
   dropped, and blocks of the same classes are one. The sketch shows which shingles may
   be too frequent for one task; their rows are dealt out and counted for real.
3. In each block every class is compared with one neighbour. The links found give
   provisional components, so dense groups of near copies are one thing from here.
4. Blocks with several components are searched with signature trees: dual traversal
   leaves the pairs of different components that can still be similar and are in reach
   of each other, so a pair is met in few of the blocks it shares. First only the
   nearest of each class is verified, until that finds no more links; then all that
   are left between the components.
5. A pair counts when the sets themselves say so; components of the links are the
   result.

Nulls and texts without a word have an empty set and no link. A text with fewer
words than a shingle is one shingle. Repeated rows and ids each keep their row; a
null id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import splittable_join
from ..sources.storage import drop_folders, folders_made, stage
from .components import components
from .frames import append_columns, nest, rows_from_texts, schema_of, utf8
from .signature_tree import BITMAP_BITS, bitmap, bitmap_size, build, dual_traversal, folded
from .words import LOWER_ASCII, make_powers, mix, shingle_hashes, words_of_texts

SHINGLE = 5
SKETCH_BITS = 18
PART_ROWS = 2000
SIEVE_BITS = 23
BATCH_ROWS = 1000  # texts or sets that go to Python at once
_SEEN = 100_000
_TEXTS = 500
_SHINGLES = 1 << 18
_SLABS = 64
_PLACES = 64  # so many places of a set are told apart


def _stage(df: DataFrame, name: str) -> DataFrame:
    return stage(df, name, BATCH_ROWS)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(words, SHINGLE))


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set; classes are told apart by it and the set's size."""
    total = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(total.astype(np.int64))


def _sets_of(column: pa.Array, powers) -> Iterator[tuple[int, np.ndarray]]:
    """Place and set of each text; a batch is turned to bytes some texts at a time."""
    for start in range(0, len(column), _TEXTS):
        texts = [t.translate(LOWER_ASCII) for t in utf8(column.slice(start, _TEXTS))]
        for i, words in words_of_texts(texts, powers):
            yield start + i, shingle_set(words)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time; what the batches have taken is given back in the end.

    A Python worker goes on to other tasks with the memory it holds.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(start, _TEXTS)
        del batch
        pa.default_memory_pool().release_unused()


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    """So many of the first elements must meet: the rest is too few for an overlap of ``num / den``."""
    return n - -(-num * n // den) + 1


def _reach(n: Column, place: Column, num: int, den: int) -> Column:
    """The largest set that a class can be similar to if the first they share is at ``place`` or later.

    Similar sets overlap by ``num / (num + den)`` of both sizes together, here at most by
    what follows the place. ``place`` counts parts of the set, ``_PLACES`` in all.
    """
    most = n - F.ceil(n * place / F.lit(_PLACES))
    return F.floor((num + den) * most / F.lit(num)).cast("long") - n


def named_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: ``(id, n, v)`` of a document, ``(slab, counts)`` of a task.

    The counts are those of a part of the sketch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = schema_of(f"id {kind}, n long, v long, slab int, counts array<long>")
    arrow = to_arrow_schema(schema)

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sketch = make_powers(), np.zeros(1 << SKETCH_BITS, np.int64)
        for part in _slices(batches):
            size = part.num_rows
            ids, sizes, keys = part.column(0).to_pylist(), [0] * size, [0] * size
            for i, shingles in _sets_of(part.column(1), powers):
                if len(shingles):
                    sizes[i], keys[i] = len(shingles), set_key(shingles)
                    np.add.at(sketch, _cell(shingles), 1)
            yield batch_of([ids, sizes, keys, [None] * size, [None] * size])
        slabs = sketch.reshape(_SLABS, -1)
        for slab in np.flatnonzero(slabs.any(axis=1)).tolist():
            yield batch_of([[None], [None], [None], [slab], [slabs[slab]]])

    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(run, schema)


def from_texts(
    docs: DataFrame, text_col: str, ddl: str,
    wanted: Callable[[int], bool],
    rows_of: Callable[[list[int], list[np.ndarray]], list[np.ndarray | pa.Array]],
) -> DataFrame:
    """Rows made from the names and sets of the wanted classes, of each task's own ones once.

    A task that meets very many classes may come back to one. Few sets are held together.
    """
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def batch_of(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(rows_of(names, sets), arrow)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = make_powers(), set()
        for part in _slices(batches):
            names, sets, size = [], [], 0
            for _, shingles in _sets_of(part.column(0), powers):
                n = len(shingles)
                if not n or not wanted(v := set_key(shingles)) or (v, n) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add((v, n))
                names.append(v)
                sets.append(shingles)
                size += n
                if size >= _SHINGLES:
                    yield batch_of(names, sets)
                    names, sets, size = [], [], 0
            if names:
                yield batch_of(names, sets)

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, schema)


def sum_sketch(named: DataFrame) -> np.ndarray:
    """The sketch of all tasks, summed in tasks: a fixed number of slabs reaches the driver."""
    schema = schema_of("slab int, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.asarray(counts.values)
                sums[slab] = sums[slab] + own if slab in sums else own.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"slab": list(sums), "counts": list(sums.values())}, to_arrow_schema(schema))

    parts = named.where("slab is not null").select("slab", "counts").repartition("slab").mapInArrow(run, schema)
    sketch = np.zeros((_SLABS, (1 << SKETCH_BITS) // _SLABS), np.int64)
    for row in parts.collect():
        sketch[row["slab"]] += np.array(row["counts"], np.int64)
    return sketch.ravel()


def likely_parts(sketch: np.ndarray) -> np.ndarray:
    """For each cell over how many tasks to deal its shingles; 1 unless one may be frequent.

    What a cell has beyond the mean of all cells bounds its most frequent shingle, but for
    chance; rare ones fill all cells alike however large the input. All of a small cell
    fits one task anyway.
    """
    usual = np.sort(sketch)[len(sketch) // 2] if len(sketch) else 0
    beyond = sketch - usual - 6 * np.sqrt(usual)
    parts = -(-np.minimum(sketch, beyond).astype(np.int64) // PART_ROWS)
    return np.where((sketch > PART_ROWS) & (beyond > PART_ROWS), parts, 1)


def prefixes(docs: DataFrame, text_col: str, sketch: np.ndarray, num: int, den: int) -> DataFrame:
    """``(shingle, part, v, size)`` for the prefix of every class that a task holds.

    ``part`` deals a shingle that may be frequent out over several tasks; -1 for the
    others. ``size`` is ``_PLACES`` times the size of the class, and the place of the
    shingle in it, rounded down: one number, as these rows are the most that is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketch, likely_parts(sketch)))

    def rows_of(names: list[int], sets: list[np.ndarray]) -> list[np.ndarray]:
        rough, parts_of = shared.value
        out = [[], [], [], []]
        for v, shingles in zip(names, sets):
            n, cells = len(shingles), _cell(shingles)
            first = np.lexsort((shingles, rough[cells]))[: prefix_length(n, num, den)]
            parts = parts_of[cells[first]]
            out[0].append(shingles[first].view(np.int64))
            out[1].append(np.where(parts > 1, np.abs(np.int64(v)) % parts, -1))
            out[2].append(np.full(len(first), v))
            out[3].append(_PLACES * n + np.arange(len(first)) * _PLACES // n)
        return [np.concatenate(c) for c in out]

    ddl = "shingle long, part int, v long, size long"
    return from_texts(docs, text_col, ddl, lambda v: True, rows_of)


def candidates(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """``(shingle, part, v, n, reach)`` of the classes with a partner of fitting size in their part.

    Of a similar pair the smaller class reaches the larger one. Classes stand in order of
    size, so it is one before that reaches the class, or the class reaches the next one.
    Rows of shingles that are dealt out stay, as their partner may be in another part.
    """
    n, place = F.floor(F.col("size") / _PLACES).cast("long"), F.pmod("size", F.lit(_PLACES))
    rows = prefix.repartition("shingle", "part").select(
        "shingle", "part", "v", n.alias("n"), _reach(n, place, num, den).alias("reach")
    )
    near = Window.partitionBy("shingle", "part").orderBy("n", "v")
    copy = (F.lag("v").over(near) == F.col("v")) & (F.lag("n").over(near) == F.col("n"))
    rows = rows.withColumn("copy", F.coalesce(copy, F.lit(False))).where("not copy").drop("copy")
    before = F.max("reach").over(near.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"before": before, "after": F.lead("n").over(near)})
    fits = F.coalesce(F.col("before") >= F.col("n"), F.lit(False))
    fits |= F.coalesce(F.col("after") <= F.col("reach"), F.lit(False))
    return rows.where(fits | (F.col("part") >= 0)).drop("before", "after")


def blocks_of(rows: DataFrame) -> DataFrame:
    """``(block, v, n, reach)``: the classes of each block of two or more; of equal blocks one.

    A block is named by its shingle's classes. Two blocks of one name would be searched
    as one, which costs time but no link. The widest reach in equal blocks counts.
    """
    class_hash = F.xxhash64("v", "n")
    whole = Window.partitionBy("shingle")
    name = F.xxhash64(F.sum(class_hash.cast("decimal(38,0)")).over(whole), F.count("*").over(whole))
    small = rows.where("part < 0").withColumns({"block": name, "size": F.count("*").over(whole)}).where("size > 1")
    # Shingles dealt out: counted for real, and named by themselves.
    dealt = rows.where("part >= 0")
    counts = dealt.groupBy("shingle").agg(F.count("*").alias("count"), F.max(F.expr("reach >= n")).alias("led"))
    counts = counts.where("count > 1 and led").select("shingle")
    large = splittable_join(dealt, counts, "shingle", "inner").withColumn("block", F.xxhash64("shingle"))
    columns = ["block", "v", "n", "reach"]
    both = small.select(columns).union(large.select(columns))
    return both.groupBy("block", "v", "n").agg(F.max("reach").alias("reach"))


def neighbours(blocks: DataFrame) -> DataFrame:
    """One other class for each, ``(a, b)``: the next smaller in reach, in most blocks."""
    by_size = Window.partitionBy("block", "part").orderBy("n", "v")
    part = F.floor(F.pmod(F.xxhash64("v", "n"), F.col("size")) / PART_ROWS)
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > PART_ROWS)
    # Large blocks are looked at in parts; any neighbour will do.
    told = splittable_join(blocks, sizes, "block", "left").withColumn("part", F.coalesce(part, F.lit(0)))
    before = {"b": F.lag(_key("v", "n")).over(by_size), "reached": F.lag("reach").over(by_size)}
    led = told.withColumns(before).where((F.col("reached") >= F.col("n")) & (F.col("reach") >= F.col("b.n")))
    return (
        led.groupBy(_key("v", "n").alias("a"), "b").agg(F.count("*").alias("c"))
        .groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    )


def held_sets(docs: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """``(v, n, shingles)`` of the classes that may be needed, of each task's own ones once."""
    shared = docs.sparkSession.sparkContext.broadcast(make_sieve(needed))

    def wanted(v: int) -> bool:
        slot = int(_sieve_slots(np.array([v]))[0])
        return bool(shared.value[slot >> 6] >> (slot & 63) & 1)

    def rows_of(names: list[int], sets: list[np.ndarray]) -> list:
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = np.concatenate(sets).view(np.int64)
        return [names, np.diff(offsets), pa.ListArray.from_arrays(offsets, values)]

    return from_texts(docs, text_col, "v long, n long, shingles array<long>", wanted, rows_of)


def _sieve_slots(v: np.ndarray) -> np.ndarray:
    return (mix(v.view(np.uint64)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def make_sieve(needed: DataFrame) -> np.ndarray:
    """A bit set of fixed size that tells which classes are needed."""
    def slots(batches):
        for batch in batches:
            at = np.unique(_sieve_slots(np.asarray(batch.column(0))))
            words = at // 64
            starts = np.flatnonzero(np.diff(words, prepend=-1))
            if len(at):
                bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), at % 64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[starts]), pa.array(bits)], names=["word", "bits"]
                )

    found = (
        needed.select("v")
        .mapInArrow(slots, "word long, bits long")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    sieve[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return sieve


def from_sets(sets: DataFrame, needed: DataFrame, ddl: str, value: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``v, n`` and a value of the set for the rows ``(v, n, shingles)`` that may be needed.

    A sieve leaves the others out before they are moved, in the same Python worker;
    where it is full it lets more rows through.
    """
    shared = sets.sparkSession.sparkContext.broadcast(make_sieve(needed))
    schema = schema_of(f"v long, n long, {ddl}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            slots = _sieve_slots(np.asarray(part.column(0)))
            words = shared.value[slots >> 6]
            kept = part.filter(pa.array((words >> (slots & 63)) & 1 == 1))
            if kept.num_rows:
                made = [kept.column(0), kept.column(1), value(kept.column(2))]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return sets.select("v", "n", "shingles").mapInArrow(run, schema)


def _bits(sets: pa.Array, size_of: Callable[[int], int]) -> pa.Array:
    made = [bitmap(np.asarray(x.values).view(np.uint64), size_of(len(x))).view(np.int64) for x in sets]
    return pa.array(made, pa.list_(pa.int64()))


def bitmaps(held: DataFrame, needed: DataFrame) -> DataFrame:
    """``(v, n, bits)`` of each needed class, one row each; larger sets have larger bitmaps."""
    made = from_sets(held, needed, "bits array<long>", lambda x: _bits(x, bitmap_size))
    return made.join(needed, ["v", "n"], "left_semi").dropDuplicates(["v", "n"])


def _ends(pairs: DataFrame) -> DataFrame:
    """The classes ``(v, n)`` that occur in ``pairs (a, b)``."""
    return pairs.select(F.explode(F.array("a", "b")).alias("k")).select("k.v", "k.n").distinct()


def sets_for(held: DataFrame, needed: DataFrame) -> DataFrame:
    """``(v, n, shingles)`` of each needed class, one row each."""
    found = from_sets(held, needed, "shingles array<long>", lambda x: x)
    return found.join(needed, ["v", "n"], "left_semi").dropDuplicates(["v", "n"])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _ones(bits: Column) -> Column:
    return F.aggregate(
        F.transform(bits, lambda x: F.bit_count(x).cast("long")), F.lit(0).cast("long"), _add
    )


def _folded(bits: Column, size: Column) -> Column:
    """A bitmap at half its size if it is larger than ``size`` words."""
    half = size.cast("int")
    return F.when(
        F.size(bits) > half,
        F.zip_with(
            F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y)
        ),
    ).otherwise(bits)


def may_be_similar(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bitmaps leave room for the overlap they need.

    Overlap is at most the common bits and the elements that share bits with others.
    Bitmaps of similar sets have the same size or one is twice the other.
    """
    keyed = bits.select(_key("v", "n").alias("k"), "bits")

    def side(df: DataFrame, name: str) -> DataFrame:
        own = keyed.select(F.col("k").alias(name), F.col("bits").alias(f"bits_{name}"))
        return splittable_join(df, own, name, "inner")

    both = side(side(pairs, "a"), "b")
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    same = both.select(
        "a", "b", _folded(F.col("bits_a"), size).alias("x"), _folded(F.col("bits_b"), size).alias("y")
    )
    common = F.aggregate(
        F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")),
        F.lit(0).cast("long"),
        _add,
    )
    spare = F.least(F.col("a.n") - _ones(F.col("x")), F.col("b.n") - _ones(F.col("y")))
    room = (num + den) * (common + spare) >= num * (F.col("a.n") + F.col("b.n"))
    return same.where(room).select("a", "b")


def fine_bitmaps(held: DataFrame, needed: DataFrame) -> DataFrame:
    """Bitmaps of at least eight bits for an element: an eighth of the sets' size, and nearly as sharp."""
    made = from_sets(
        held, needed, "bits array<long>",
        lambda x: _bits(x, lambda n: max(BITMAP_BITS, 1 << (8 * n - 1).bit_length())),
    )
    return made.join(needed, ["v", "n"], "left_semi").dropDuplicates(["v", "n"])


def _key(v: str, n: str) -> Column:
    """A class: its size and the name of its set."""
    return F.struct(F.col(n).alias("n"), F.col(v).alias("v"))


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes that are similar, decided on the sets."""
    own = from_sets(sets, _ends(pairs), "shingles array<long>", lambda x: x)
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("k"))
    # Each end finds its set, then the two ends meet: every set goes once to each of its pairs.
    told = splittable_join(ends, own.select(_key("v", "n").alias("k"), "shingles"), "k", "inner")
    met = told.groupBy("a", "b").agg(F.collect_list("shingles").alias("s"))
    both = F.size(F.array_intersect(F.get("s", F.lit(0)), F.get("s", F.lit(1))))
    return met.where((num + den) * both >= num * (F.col("a.n") + F.col("b.n"))).select("a", "b")


def _trees(rows: list[tuple], labels: dict) -> dict[int, tuple[np.ndarray, list]]:
    """For each size of bitmap the places of its rows and their tree."""
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_size.setdefault(len(r[6]), []).append(i)
    trees = {}
    for size, own in by_size.items():
        own.sort(key=lambda i: (rows[i][3], labels[rows[i][5]], rows[i][2]))
        bits = np.array([rows[i][6] for i in own], np.int64).view(np.uint64)
        sizes, reach = (np.array([rows[i][k] for i in own]) for k in (3, 4))
        trees[size] = np.array(own), build(bits, sizes, np.array([labels[rows[i][5]] for i in own]), reach)
    return trees


def search_block(
    one: list[tuple], two: list[tuple] | None, num: int, den: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``one`` and in ``two`` (None: in ``one`` again) of possible pairs, and their common bits.

    Rows are ``(task, part, v, n, reach, label, bits, block)``. Similar sets have bitmaps of one size or
    of neighbouring ones; of these the larger is folded.
    """
    labels = {c: i for i, c in enumerate(dict.fromkeys(r[5] for r in [*one, *(two or [])]))}
    if len(labels) < 2:
        return
    left = _trees(one, labels)
    right = left if two is None else _trees(two, labels)
    for size, (at, tree) in left.items():
        for other in (size // 2, size, 2 * size):
            if other not in right or (two is None and other < size):
                continue
            to, second = right[other]
            width = min(size, other)
            a, b = (t if len(t[0].bits[0]) == width else folded(t) for t in (tree, second))
            same = two is None and other == size
            for i, j in dual_traversal(a, None if same else b, num, den):
                yield at[i], to[j], np.bitwise_count(a[0].bits[i] & b[0].bits[j]).sum(axis=1).astype(np.int64)


def tree_pairs(blocks: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """``(block, x, y, share)``: candidate pairs of different components inside blocks.

    ``blocks``: ``block, parts, part, v, n, reach, label, bits``. Signature trees leave the
    pairs whose bitmaps have room for the overlap. ``nearest`` keeps the best of them
    for each class in each task, as ``x``; otherwise all come.
    A block of several parts is searched by pairs of parts, one task each; a part is
    sent once for every part it is compared with.
    """
    schema = schema_of("block long, va long, na long, vb long, nb long, share long")

    def search(rows: list[tuple]) -> Iterator[list[np.ndarray]]:
        sides = sorted({r[1] for r in rows})
        one = [r for r in rows if r[1] == sides[0]]
        two = [r for r in rows if r[1] == sides[1]] if len(sides) > 1 else None
        lists = [one, one if two is None else two]
        names = [np.array([(r[2], r[3]) for r in x], np.int64) for x in lists]
        best = [np.full(len(one), -1, np.int64)]
        best.append(best[0] if two is None else np.full(len(two), -1, np.int64))
        for i, j, common in search_block(one, two, num, den):
            share = common * (1 << 20) // (names[0][i, 1] + names[1][j, 1])
            if not nearest:
                yield [*names[0][i].T, *names[1][j].T, share]
                continue
            np.maximum.at(best[0], i, share << 32 | j)
            np.maximum.at(best[1], j, share << 32 | i)
        if nearest:
            for side, other in ((0, 1), (1, 0))[: 1 if two is None else 2]:
                i = np.flatnonzero(best[side] >= 0)
                j = best[side][i] & 0xFFFFFFFF
                yield [*names[side][i].T, *names[other][j].T, best[side][i] >> 32]

    def run(batches):
        key, rows, pending, size = None, [], [], 0

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*pending)], names=schema.names
            )

        def blocks_in():
            nonlocal key, rows
            for batch in batches:
                *plain, bits, block = batch.columns
                for *row, held, name in zip(*(c.to_pylist() for c in plain), bits, block.to_pylist()):
                    if row[0] != key:
                        yield rows
                        key, rows = row[0], []
                    rows.append((*row, np.asarray(held.values), name))
            yield rows

        for block in blocks_in():
            if len(block) < 2:
                continue
            for found in search(block):
                pending.append([np.full(len(found[0]), block[0][7]), *found])
                size += len(found[0])
                if size > 20_000:
                    yield emit()
                    pending, size = [], 0
        if pending:
            yield emit()

    meet = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(
            F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")
        ),
    )
    dealt = (
        blocks.withColumn("meet", F.explode(meet))
        .select(F.xxhash64("block", "meet").alias("task"), "part", "v", "n", "reach", "label", "bits", "block")
        .repartition("task")
        .sortWithinPartitions("task", "part")
    )
    found = dealt.select(
        "task", "part", "v", "n", "reach", F.concat_ws(":", "label.n", "label.v").alias("label"), "bits", "block"
    ).mapInArrow(run, schema)
    return found.select("block", _key("va", "na").alias("x"), _key("vb", "nb").alias("y"), "share")


def nearest_pairs(found: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of each class with its nearest one."""
    both = found.groupBy("x").agg(F.max_by("y", F.struct("share", "y")).alias("y"))
    return _unordered(both)


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Provisional component of each row's class: itself if it has no link."""
    own = labels.select(F.col("vertex").alias("k"), F.col("label").alias("found"))
    keyed = rows.withColumn("k", _key("v", "n"))
    joined = splittable_join(keyed, own, "k", "left")
    return joined.withColumn("label", F.coalesce("found", _key("v", "n"))).drop("found")


def open_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the blocks that hold several components.

    Components only grow, so a later call needs no more than an earlier one returned.
    """
    rows = _stage(_labelled(blocks.select("block", "v", "n", "reach"), labels), "join_labelled")
    label = F.xxhash64("label.n", "label.v")
    several = (
        rows.groupBy("block")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("size"))
        .where("low <> high")
        .select("block", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts"))
    )
    chosen = splittable_join(rows, _stage(several, "join_open"), "block", "inner")
    part = F.pmod(F.xxhash64("v", "n"), F.col("parts")).cast("int")
    return _stage(chosen.withColumn("part", part), "join_open_rows")


def with_bits(rows: DataFrame, bits: DataFrame) -> DataFrame:
    own = bits.select(_key("v", "n").alias("k"), "bits")
    return splittable_join(rows, own, "k", "inner")


def _verified(
    pairs: DataFrame, held: DataFrame, sets: DataFrame, num: int, den: int
) -> tuple[DataFrame, DataFrame]:
    """The sets known so far and those that were missing; the pairs that are similar.

    Fine bitmaps leave few pairs that are not, so few sets are moved for nothing.
    """
    fine = _stage(fine_bitmaps(held, _ends(pairs)), "join_fine")
    close = _stage(may_be_similar(pairs, fine, num, den), "join_close")
    more = _ends(close).join(sets.select("v", "n"), ["v", "n"], "left_anti")
    sets = sets.unionByName(_stage(sets_for(held, more), "join_sets"))
    return sets, _stage(verify(close, sets, num, den), "join_links")


def link_classes(docs: DataFrame, text_col: str, sketch: np.ndarray, num: int, den: int) -> DataFrame:
    """``(vertex, label)`` of all classes that are similar to another one."""
    with folders_made() as passed:
        rows = _stage(candidates(prefixes(docs, text_col, sketch, num, den), num, den), "join_candidates")
    blocks = _stage(blocks_of(rows), "join_blocks")
    drop_folders(docs.sparkSession, passed)
    needed = blocks.select("v", "n").distinct()
    held = _stage(held_sets(docs, text_col, needed), "join_held")
    bits = _stage(bitmaps(held, needed), "join_bitmaps")

    # One neighbour for each class: the one met in most blocks.
    met = _stage(neighbours(blocks), "join_met")
    tried = _stage(may_be_similar(met, bits, num, den), "join_tried")
    sets = _stage(sets_for(held, _ends(tried)), "join_sets")
    links = _stage(verify(tried, sets, num, den), "join_links")
    labels = components(links, "a", "b")

    # The nearest class of another component, again and again while that finds links:
    # what is dense grows together without comparing all pairs in it.
    first = 0
    while True:
        blocks = open_blocks(blocks, labels)
        seen = _stage(tree_pairs(with_bits(blocks, bits), num, den, True), "join_seen")
        near = _stage(nearest_pairs(seen), "join_near")
        sets, new = _verified(near, held, sets, num, den)
        links = links.unionByName(new)
        labels = components(links, "a", "b")
        # Components only grow: who has met nobody in a block never will.
        blocks = blocks.join(seen.select("block", "x.v", "x.n").distinct(), ["block", "v", "n"], "left_semi")
        found = new.count()
        first = first or found
        if 10 * found <= first:
            break
    # What is left between components, in full.
    rest = tree_pairs(with_bits(open_blocks(blocks, labels), bits), num, den, False)
    rest = _stage(_unordered(rest), "join_rest")
    _, new = _verified(rest, held, sets, num, den)
    return components(links.unionByName(new), "a", "b")


def group_classes(
    docs: DataFrame, id_col: str, text_col: str, num: int, den: int
) -> tuple[DataFrame, DataFrame]:
    """Documents as ``(id, n, v)``, and ``(k, label, least_id)`` of every class.

    ``docs`` is read three times.
    """
    named = _stage(named_sets(docs, id_col, text_col), "join_named_sets")
    labels = link_classes(docs, text_col, sum_sketch(named), num, den)
    members = named.where("slab is null").select("id", "n", "v")
    classes = members.where("n > 0").groupBy("v", "n").agg(F.min("id").alias("least_id"))
    return members, _labelled(classes, labels).select("k", "label", "least_id")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    num: int = 3,
    den: int = 4,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id in it).

    Linked are documents with Jaccard similarity of at least ``num / den``.
    """
    members, named = group_classes(_narrow(docs, id_col, text_col), id_col, text_col, num, den)
    least = named.groupBy("label").agg(F.min("least_id").alias("component"))
    of_class = splittable_join(named, least, "label", "inner").select("k", "component")
    joined = splittable_join(members.withColumn("k", _key("v", "n")), of_class, "k", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    num: int = 3,
    den: int = 4,
) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the smallest id.

    Rows without a word are in no group and stay. Of rows that repeat the id and the
    shingles of the one to keep, any one stays. Documents that may have to go are moved, by
    keys of their own, so a large group is spread like all others; the rest stays in place.
    """
    with folders_made() as passed:
        members, named = group_classes(_narrow(docs, id_col, text_col), id_col, text_col, num, den)
        named = _stage(named, "join_named")
    # The first class by smallest id; classes without any id come last.
    first = F.min_by(F.struct("k", "least_id"), F.struct(F.col("least_id").isNull(), "least_id", "k"))
    winners = named.groupBy("label").agg(first.alias("w")).select(
        F.col("w.k").alias("k"), F.struct(F.col("w.least_id").alias("id")).alias("winner")
    )
    counted = members.where("n > 0").groupBy("id", "n", "v").agg(F.count("*").alias("rows"))
    told = splittable_join(counted.withColumn("k", _key("v", "n")), winners, "k", "left")
    # The winner is a struct, null for a class that lost; the id inside may be null.
    won = F.col("winner").isNotNull() & F.col("id").eqNullSafe(F.col("winner.id"))
    flags = _stage(
        told.where(~won | (F.col("rows") > 1)).select(
            F.struct("id", "n", "v").alias("_key"),
            F.when(won, "one of several").otherwise("drop").alias("_flag"),
        ),
        "join_flags",
    )
    drop_folders(docs.sparkSession, passed)
    shared = docs.sparkSession.sparkContext.broadcast(make_sieve(flags.select("_key.v")))
    # The text goes to Python once, inside its row.
    names = docs.columns if text_col in docs.columns else [c.lower() for c in docs.columns]
    at = names.index(text_col if text_col in names else text_col.lower())
    keyed = append_columns(
        nest(docs, id=id_col), "row", "n long, v long, flagged boolean", lambda: _make_keys(at, shared.value)
    )
    # Only documents that may have a flag are moved, by keys of their own.
    kept = keyed.where("not flagged").select("row.*")
    joined = keyed.where("flagged").withColumn("_key", F.struct("id", "n", "v")).join(flags, "_key", "left")
    kept = kept.unionByName(joined.where("_flag is null").select("row.*"))
    if flags.where("_flag <> 'drop'").isEmpty():
        return kept
    one = joined.where("_flag = 'one of several'").dropDuplicates(["_key"])
    return kept.unionByName(one.select("row.*"))


def _make_keys(at: int, sieve: np.ndarray):
    powers = make_powers()

    def keys(rows: pa.StructArray):
        sizes, names = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i, shingles in _sets_of(rows.flatten()[at], powers):
            if len(shingles):
                sizes[i], names[i] = len(shingles), set_key(shingles)
        slots = _sieve_slots(names)
        return sizes, names, (sieve[slots >> 6] >> (slots & 63)) & 1 == 1

    return keys
