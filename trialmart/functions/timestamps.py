"""Parsing of raw time text, time zones and the experiment window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import TIMESTAMP_FORMATS

# A letter or a sign after the time of day.
_NAMES_ZONE = r"[T ]\d{1,2}:\d{1,2}[0-9:.\s]*([A-Za-z]|[+-]\d)"
_OFFSET_SUFFIX = r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$"


def wall_as_utc(wall: Column) -> Column:
    """The instant at which UTC clocks show a zone-less time.

    Built from its parts: casts between the two kinds of time go through the time
    zone of the session, which must not matter.
    """
    minutes = (F.unix_date(wall.cast("date")).cast("long") * 24 + F.hour(wall)) * 60 + F.minute(wall)
    micros = (F.date_part(F.lit("SECOND"), wall) * 1_000_000).cast("long")
    return F.timestamp_micros(minutes * 60_000_000 + micros)


def parse_plain(col: Column) -> Column:
    """Timestamp of a text in the usual formats, read as UTC unless it names a zone."""
    text = col.cast("string")
    return F.when(text.rlike(_NAMES_ZONE), F.try_to_timestamp(text)).otherwise(
        wall_as_utc(text.try_cast("timestamp_ntz"))
    )


def parse_timestamp(col: Column) -> Column:
    """Timestamp of a text in any accepted format, NULL if none fits (PRJ1).

    Spark's own parser reads all the formats but a few offset spellings, and it
    is compiled code, so it goes first; the pattern-based ones only see what it
    left. Where two of them accept a text they name the same instant. The result
    does not depend on the time zone of the session.
    """
    text = col.cast("string")
    left = [
        F.try_to_timestamp(text, F.lit(fmt))
        if fmt.endswith("X")
        else F.from_utc_timestamp(F.try_to_timestamp(text, F.lit(fmt)), F.current_timezone())
        for fmt in TIMESTAMP_FORMATS
    ]
    return F.coalesce(parse_plain(text), *left)


def utc_date(ts: Column | str) -> Column:
    """The day of an instant in UTC, whatever the time zone of the session."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))


def start_of_day(day: Column | str) -> Column:
    """The instant at which a day begins in UTC."""
    day = F.col(day) if isinstance(day, str) else day
    return F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000)


def has_offset(col: Column) -> Column:
    """Whether the text names its own UTC offset."""
    return F.coalesce(F.trim(col.cast("string")).rlike(_OFFSET_SUFFIX), F.lit(False))


def event_time(scheduled_flag: Column, scheduled_utc: Column, created_utc: Column) -> Column:
    """Scheduled time of a scheduled order unless it precedes creation (PRJ5)."""
    return F.when(scheduled_flag & (scheduled_utc >= created_utc), scheduled_utc).otherwise(
        created_utc
    )


def business_date(ts_utc: Column, business_tz: str) -> Column:
    return utc_date(F.from_utc_timestamp(ts_utc, business_tz))


def as_bound(bound: str | Column | None) -> Column | None:
    """A window bound given as ISO text or as a column (e.g. a scalar subquery)."""
    if bound is None or isinstance(bound, Column):
        return bound
    return parse_plain(F.lit(bound))
