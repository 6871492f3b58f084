"""Clocks of the sources as seconds or microseconds since 1970-01-01 UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sources' clocks.
MJD_OF_1970 = 40587
TAI_MINUS_UTC = 37
SECONDS_TO_2000_NOON = 946728000


def micros(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def seconds(ts: Column) -> Column:
    """Whole seconds of a zone-free timestamp, rounded down."""
    return F.floor(micros(ts) / 1_000_000)


def from_mjd(mjd: Column) -> Column:
    return (mjd - MJD_OF_1970) * 86400.0


def from_2000_noon(s: Column) -> Column:
    return s + SECONDS_TO_2000_NOON


def from_tai(text: Column, form: str = "yyyy.MM.dd_HH:mm:ss") -> Column:
    """Seconds UTC of a TAI time such as 2024.01.31_12:00:00_TAI; null where it can't be read."""
    bare = F.regexp_replace(text, "_TAI$", "")
    return seconds(F.try_to_timestamp(bare, F.lit(form)).cast("timestamp_ntz")) - TAI_MINUS_UTC


def parsed(text: Column) -> Column:
    """Zone-free timestamp from the first form that fits; null where none does."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms])


def to_text(s: Column) -> Column:
    """Seconds as yyyy-MM-dd HH:mm:ss UTC."""
    day, rest = F.floor(s / 86400).cast("int"), F.pmod(F.floor(s), F.lit(86400))
    return F.concat_ws(" ", F.date_from_unix_date(day).cast("string"), F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60))


def time_of_day(s: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day."""
    turn = F.pmod(s, F.lit(86400)) * (2 * 3.141592653589793 / 86400)
    return F.sin(turn), F.cos(turn)
