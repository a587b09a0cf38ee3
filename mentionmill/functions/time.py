"""Epoch seconds, local wall clocks and calendar labels.

Local clocks are kept as plain numbers or TIMESTAMP_NTZ, so results do not depend on the session time
zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BERLIN = "Europe/Berlin"


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970 from a digit string or an ISO-8601 string; null when neither parses."""
    return F.coalesce(
        value.try_cast("bigint"),
        F.unix_seconds(value.try_cast("timestamp")),
    )


def iso_to_epoch_text(date: Column) -> Column:
    """An ISO-8601 date with offset as a string of epoch seconds."""
    return F.unix_seconds(date.try_cast("timestamp")).cast("string")


def _local_seconds(seconds: Column, tz: str) -> Column:
    """Seconds a wall clock in ``tz`` has counted since 1970, as a plain number."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz))


def _wall_clock(seconds: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '1' SECOND") * seconds


def local_time(seconds: Column, tz: str = BERLIN) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) in ``tz`` for epoch seconds."""
    return _wall_clock(_local_seconds(seconds, tz))


def day_label(seconds: Column, tz: str = BERLIN) -> Column:
    """The local calendar day."""
    local = _local_seconds(seconds, tz)
    return F.date_from_unix_date(F.floor(local / 86400).cast("int"))


def week_label(seconds: Column, tz: str = BERLIN) -> Column:
    """The Sunday that closes the local Monday-to-Sunday week."""
    local = _local_seconds(seconds, tz)
    # day 3 (4 January 1970) was a Sunday, and so is every seventh day from it
    days = F.floor(local / 86400)
    return F.date_from_unix_date((F.ceil((days - 3) / 7) * 7 + 3).cast("int"))


def utc_label(day: Column, tz: str = BERLIN) -> Column:
    """Local midnight of ``day`` as an ISO string in UTC, e.g. ``2023-03-25T23:00:00.000Z``."""
    midnight = F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400)
    utc = _wall_clock(F.unix_seconds(F.to_utc_timestamp(midnight, tz)))
    return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit(".000Z"))
