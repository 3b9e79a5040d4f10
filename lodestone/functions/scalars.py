"""Defaults, times and number shaping used by the usage log and the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number_or_zero(c: Column) -> Column:
    """Null and NaN count as 0."""
    as_double = c.try_cast("double")
    return F.coalesce(F.nanvl(as_double, F.lit(0.0)), F.lit(0.0))


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def label_or(c: Column, default: str) -> Column:
    """An empty or missing label becomes ``default``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def iso_utc(ts: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC with milliseconds and Z, in any session time zone."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wall_clock_hour(text: Column) -> Column:
    """Hour as written in the text, whatever its offset; null for bad text.

    The date has to be whole (a date alone is hour 0); the ISO form without separators counts as well.
    """
    dated = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    timed = F.regexp_replace(dated, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    timed = F.regexp_replace(timed, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")
    return F.when(timed.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.hour(timed.try_cast("timestamp_ntz")))


def event_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def draw(seed: str, *parts: Column) -> Column:
    """A repeatable pseudo-random key: md5 over the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def draw_below(limit: Column, seed: str, *parts: Column) -> Column:
    """A repeatable whole number from 0 to limit - 1 (60 random bits)."""
    bits = F.conv(F.substring(draw(seed, *parts), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, limit)
