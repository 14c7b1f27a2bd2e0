"""Personal data in texts: fixed kinds, and terms that give it away.

Base spans are e-mail and IP addresses, card and phone numbers. A term (a word of
letters) discloses an entity when it occurs near it so often that a reader of the
term knows the entity all but ``slack_bits``: pointwise mutual information of at
least the entity's own information less the slack, ``log2(n(term) / n(term near
entity)) <= slack_bits``, counted over all documents. Such terms are removed, or
generalised if some doubt is left: with ``everywhere`` in all documents, as a term
gives the entity away where the entity itself is not written too; else only in
documents that hold the entity.

Everything is column expressions. Null texts count as empty. Offsets are code
points, ends exclusive. Repeated rows and ids are handled row by row; columns of
the input with the names of result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import splittable_join
from ..sources.storage import stage
from . import sieve
from .frames import nest

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The same matches as the plain patterns, in time proportional to the text: a run is
# entered at its start (or right after a match) only, and is never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP_RANGE = rf"^{_PART}(?:\.{_PART}){{3}}$"
LETTERS = r"\p{L}{3,}"
WINDOW = 64
_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _running_sums(lengths: Column) -> Column:
    """Sums of all values before each, by chunks so that long arrays stay cheap."""
    n = F.size(lengths)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")),
        lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)),
    )

    def finish(parts: Column) -> Column:
        return let(
            F.transform(parts, _sum),
            lambda sums: F.flatten(
                F.transform(
                    F.transform(
                        parts,
                        lambda x, c: F.struct(
                            x.alias("x"), _sum(F.slice(sums, F.lit(1), c)).alias("base")
                        ),
                    ),
                    lambda p: F.transform(
                        p["x"], lambda _, i: p["base"] + _sum(F.slice(p["x"], F.lit(1), i))
                    ),
                )
            ),
        )

    return let(chunks, finish)


SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def spans(text: Column, pattern: Column) -> Column:
    """All matches with their offsets and the text on both sides, left to right.

    The pieces between matches and the matches themselves give the offsets.
    """
    pieces = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
    )

    def build(p: Column) -> Column:
        lengths = F.zip_with(
            F.slice(p["gaps"], F.lit(1), F.size(p["found"])),
            p["found"],
            lambda g, m: F.length(g) + F.length(m),
        )

        def place(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                gap = F.get(p["gaps"], i)
                start = F.get(before, i) + F.length(gap)
                return F.struct(
                    start.alias("start"),
                    (start + F.length(m)).alias("end"),
                    m.alias("value"),
                    F.right(gap, F.lit(WINDOW)).alias("before"),
                    F.left(F.get(p["gaps"], i + 1), F.lit(WINDOW)).alias("after"),
                )

            return F.transform(p["found"], one)

        return let(let(lengths, _running_sums), place)

    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(F.rlike(text, pattern), let(pieces, build).cast(f"array<{SPAN}>")).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda s: s["value"].rlike(_IP_RANGE)
    if kind == "card":
        return lambda s: let(
            _digits(s["value"]),
            lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False),
        )
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(9, 15)
    return lambda s: F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = spans(text, F.lit(PATTERNS[kind]))
    kept = found if kind == "email" else F.filter(found, _valid(kind))
    sign = {"email": "@", "phone": "+"}.get(kind)
    if sign:  # no sign, no match
        kept = F.when(F.contains(text, F.lit(sign)), kept).otherwise(
            F.array().cast(f"array<{SPAN}>")
        )
    return kept


def _with_base(docs: DataFrame, text_col: str) -> DataFrame:
    whole = nest(docs, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    return whole.withColumns({f"_{k}": base_spans(F.col("_text"), k) for k in KINDS})


def _has_any() -> Column:
    return sum((F.size(f"_{k}") for k in KINDS), F.lit(0)) > 0


def _entities() -> Column:
    """All base spans of a row: entity key and the words around."""
    def of(kind: str) -> Column:
        def one(s: Column) -> Column:
            value = _digits(s["value"]) if kind in ("card", "phone") else F.lower(s["value"])
            # A word cut by the edge of the window does not count.
            before = F.when(
                F.length(s["before"]) == WINDOW, F.regexp_replace(s["before"], r"^\p{L}+", "")
            ).otherwise(s["before"])
            after = F.when(
                F.length(s["after"]) == WINDOW, F.regexp_replace(s["after"], r"\p{L}+$", "")
            ).otherwise(s["after"])
            near = F.lower(F.concat(before, F.lit(" "), after))
            return F.struct(
                F.concat(F.lit(f"{kind}:"), value).alias("entity"),
                F.array_distinct(F.regexp_extract_all(near, F.lit(LETTERS), F.lit(0))).alias("near"),
            )

        return F.transform(f"_{kind}", one)

    return F.concat(*[of(k) for k in KINDS])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def disclosing_terms(
    found: DataFrame, docs: DataFrame, text_col: str, slack_bits: float, support: int
) -> tuple[DataFrame, Column]:
    """``(term, entity, bits)`` of the pairs over the threshold, and a sieve of terms.

    Only terms seen ``support`` times near one entity are counted in the corpus, and
    the sieve drops the other words before they are shuffled.
    """
    near = found.select(F.explode(_entities()).alias("e")).select(
        "e.entity", F.explode("e.near").alias("term")
    )
    pairs = stage(
        near.groupBy("term", "entity").agg(F.count("*").alias("n_near")).where(
            F.col("n_near") >= support
        ),
        "pii_pairs",
    )
    terms = sieve.build(pairs, "term")
    corpus = (
        docs.select(F.explode(_words(F.col(f"`{text_col}`"))).alias("term"))
        .where(sieve.passes(terms, F.col("term")))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    bits = F.greatest(F.lit(0.0), F.log2(F.col("n_term") / F.col("n_near")))
    disclosing = splittable_join(pairs, corpus, "term", "inner").select("term", "entity", bits.alias("bits"))
    return stage(disclosing.where(F.col("bits") <= slack_bits), "pii_disclosing"), terms


def find_private(
    docs: DataFrame,
    text_col: str = "text",
    *,
    slack_bits: float = 1.0,
    support: int = 3,
    everywhere: bool = False,
) -> DataFrame:
    """``docs`` with ``pii``: kind, start, end and ``bits`` (terms only) of each span.

    Base kinds come in their fixed order, then terms, each from left to right.
    Rows with base spans are staged with a number of their own, as the terms
    found for them have to come back to the same row; with ``everywhere`` so are the
    other rows that may hold a disclosing term. All others pass through.
    """
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c != "pii"]
    marked = _with_base(docs, text_col)
    found = stage(
        marked.where(_has_any()).withColumn("_row", F.monotonically_increasing_id()), "pii_found"
    )
    disclosing, terms = disclosing_terms(found, docs, text_col, slack_bits, support)
    clean = marked.where(~_has_any())
    if everywhere:
        disclosing = stage(
            disclosing.groupBy("term").agg(F.min("bits").alias("bits")), "pii_disclosing_terms"
        )
        terms = sieve.build(disclosing, "term")
        may_hold = F.exists(_words(F.col("_text")), lambda w: sieve.passes(terms, w))
        # Numbers below zero, so that they differ from those of the other rows.
        touched = clean.where(may_hold).withColumn("_row", -1 - F.monotonically_increasing_id())
        found = found.unionByName(stage(touched, "pii_touched"))
        clean = clean.where(~may_hold)
    likely = F.filter(
        F.array_distinct(_words(F.col("_text"))), lambda w: sieve.passes(terms, w)
    )
    words = found.select("_row", F.explode(likely).alias("term"))
    own = splittable_join(words, disclosing, "term", "inner")
    if not everywhere:
        held = found.select("_row", F.explode(F.array_distinct(F.transform(
            _entities(), lambda e: e["entity"]))).alias("entity"))
        own = own.join(held, ["_row", "entity"], "left_semi")
    by_row = own.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct("term", "bits"))).alias("_terms")
    )
    joined = found.join(by_row, "_row", "left")
    base = _kind_spans()
    pattern = F.concat(
        F.lit(r"(?iu)(?<!\p{L})(?:"),
        F.array_join(F.transform("_terms", lambda t: t["term"]), "|"),
        F.lit(r")(?!\p{L})"),
    )
    free = F.filter(
        spans(F.col("_text"), pattern),
        lambda t: ~F.exists(
            base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])
        ),
    )

    def term_span(t: Column) -> Column:
        same = F.filter("_terms", lambda x: x["term"] == F.lower(t["value"]))
        return F.struct(
            F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"),
            F.array_min(F.transform(same, lambda x: x["bits"])).alias("bits"),
        )

    terms_found = F.when(
        F.col("_terms").isNotNull(), F.transform(free, term_span)
    ).otherwise(F.array().cast(f"array<{PII}>"))
    with_terms = joined.select(*columns, F.concat(base, terms_found).cast(f"array<{PII}>").alias("pii"))
    clean = clean.select(*columns, F.array().cast(f"array<{PII}>").alias("pii"))
    return clean.unionByName(with_terms)


PII = "struct<kind:string,start:int,end:int,bits:double>"


def _kind_spans() -> Column:
    def of(kind: str) -> Column:
        def one(s: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(None).cast("double").alias("bits"),
            )

        return F.transform(f"_{kind}", one)

    return F.concat(*[of(k) for k in KINDS])


def listed(spans_col: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, digest of the base spans and the list of all spans."""
    def of(kind: str) -> Column:
        return F.filter("pii", lambda s: s["kind"] == kind)

    return marked.select(
        id_col,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("pii", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )


def sanitise(
    docs: DataFrame, text_col: str = "text", *, remove_bits: float = 0.5, **options
) -> DataFrame:
    """``docs`` with private spans replaced by their kind in the text.

    Terms that leave at most ``remove_bits`` of doubt are removed, others
    generalised to ``[TERM]``. Overlapping spans go as one. Null texts stay null.
    """
    whole = nest(docs, text=text_col)
    marked = find_private(whole, "text", **options)
    text = F.col("text")
    ordered = F.array_sort(
        F.transform(
            "pii",
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
                .when(s["bits"] <= remove_bits, "")
                .otherwise("[TERM]").alias("label"),
            ),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(
            s["start"] >= a["at"],
            F.struct(F.concat(a["out"], kept, s["label"]).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    def finish(a: Column) -> Column:
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))

    clean = F.when(F.size("pii") == 0, text).otherwise(F.aggregate(ordered, start, step, finish))
    columns = [
        clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns
    ]
    return marked.select(*columns)
