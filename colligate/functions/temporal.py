"""Dates, times, durations: text to values and back. Text that does not parse gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_datetime(text: Column) -> Column:
    """RFC-822 text (any weekday is skipped) or ISO text, as a timestamp."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zones = ("dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx")
    lettered = bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} ")
    return F.when(lettered, F.coalesce(*[F.try_to_timestamp(bare, F.lit(z)) for z in zones])).otherwise(F.try_to_timestamp(bare))


def format_rfc822(at: Column) -> Column:
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z")


def unix_seconds(at: Column) -> Column:
    return F.unix_timestamp(at)


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_time(text: Column) -> Column:
    """h:m:s[.mmm] as HH:MM:SS.mmm text; a second of 60 is a leap second and allowed."""
    parts = [F.regexp_extract(text, r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?$", i) for i in range(1, 5)]
    whole = text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:([0-5]?\d|60)(\.\d{1,3})?$")
    clock = F.concat_ws(":", *[F.lpad(p, 2, "0") for p in parts[:3]])
    return F.when(whole, F.concat(clock, F.lit("."), F.rpad(parts[3], 3, "0")))


def parse_duration(text: Column) -> Column:
    """H:MM:SS[.mmm], 1d2h3m4s5ms, or milliseconds, as milliseconds."""
    sign = F.when(F.trim(text).startswith("-"), -1).otherwise(1)
    bare = F.regexp_replace(F.trim(text), r"^[-+]", "")
    clock = r"^(\d+):([0-5]?\d):([0-5]?\d)(?:\.(\d{1,3}))?$"
    n = lambda i: F.regexp_extract(bare, clock, i)
    by_clock = n(1).try_cast("long") * 3600000 + n(2).try_cast("long") * 60000 + n(3).try_cast("long") * 1000 + F.coalesce(F.rpad(n(4), 3, "0").try_cast("long"), F.lit(0))
    units = {"d": 86400000, "h": 3600000, "m": 60000, "s": 1000, "ms": 1}
    by_unit = sum(F.coalesce(F.regexp_extract(bare, rf"(\d+){u}(?![a-z])", 1).try_cast("long"), F.lit(0)) * k for u, k in units.items())
    value = (
        F.when(bare.rlike(clock), by_clock)
        .when(bare.rlike(r"^(\d+d)?(\d+h)?(\d+m)?(\d+s)?(\d+ms)?$") & (bare != ""), by_unit)
        .when(bare.rlike(r"^\d+$"), bare.try_cast("long"))
    )
    return sign * value


def format_duration(ms: Column) -> Column:
    """H:MM:SS, and .mmm where there are milliseconds."""
    a = F.abs(ms)
    whole = F.concat(
        F.when(ms < 0, "-").otherwise(""), F.floor(a / 3600000).cast("string"), F.lit(":"),
        F.lpad((F.floor(a / 60000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(a / 1000) % 60).cast("string"), 2, "0"),
    )
    return F.when(a % 1000 == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0")))
