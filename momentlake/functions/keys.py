"""Compared forms of keys and readable times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compared(c: Column | str) -> Column:
    """Trimmed and lower-cased; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def epoch_seconds(c: Column | str) -> Column:
    """Whole epoch seconds of a written time that carries its zone (ISO date and time, ``T`` or blank between, optional
    fraction, zone ``Z``, ``+hh:mm``, ``+hhmm`` or ``+hh``) or of a count of epoch seconds (9 to 11 digits); null if unreadable."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    iso = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,]\d+)? ?([Zz]|[+-]\d{2}(?::?\d{2})?)$"
    zone = F.regexp_extract(t, iso, 3)
    hours = F.regexp_extract(zone, r"^([+-]\d{2})", 1)
    minutes = F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1)
    offset = F.when(F.upper(zone) == "Z", F.lit(0)).otherwise(
        F.expr("1") * (F.abs(hours.try_cast("int")) * 3600 + F.coalesce(minutes.try_cast("int"), F.lit(0)) * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    )
    local = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(t, iso, 1), F.regexp_extract(t, iso, 2), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX"))
    return F.when(t.rlike(iso), F.unix_seconds(local) - offset).when(t.rlike(r"^\d{9,11}(?:\.\d+)?$"), F.regexp_extract(t, r"^(\d+)", 1).try_cast("long"))


def epoch_of(c: Column | str) -> Column:
    """Epoch seconds (double) of a zoneless timestamp that means UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / F.lit(1e6)
