"""Column functions on time. Nothing here reads the clock: "now" is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

FILETIME_UNIX_EPOCH = 116444736000000000


def instant(value) -> Column:
    """A timestamp literal from a datetime, an ISO text or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.to_timestamp(F.lit(value))


def iso_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp, null when it does not parse; nanoseconds are cut to microseconds."""
    return F.try_to_timestamp(F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(c)))


def windows_ts(c: Column, as_of) -> Column:
    return F.coalesce(iso_ts(c), instant(as_of))


def filetime_ts(c: Column, as_of) -> Column:
    """100-nanosecond ticks since 1601 to timestamp; values before 1970 become ``as_of``."""
    ticks = c - F.lit(FILETIME_UNIX_EPOCH)
    return F.when(ticks >= 0, F.timestamp_micros(F.call_function("div", ticks, F.lit(10)))).otherwise(instant(as_of))


SYSLOG_STAMP = r"^([A-Z][a-z]{2}) ([ \d]\d) (\d{2}:\d{2}:\d{2})"
ISO_STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2}))"


def syslog_ts(line: Column, year: int) -> Column:
    """Timestamp at the start of a syslog line, null when there is none; ``year`` completes RFC 3164 stamps."""
    # The stamp has fixed columns: month 1-3, day 5-6 (padded with a blank or a zero), clock 8-15.
    day = F.lpad(F.trim(F.substring(line, 5, 2)), 2, "0")
    short = F.concat_ws(" ", F.lit(str(year)), F.substring(line, 1, 3), day, F.substring(line, 8, 8))
    return F.coalesce(
        F.when(line.rlike(SYSLOG_STAMP), F.try_to_timestamp(short, F.lit("yyyy MMM dd HH:mm:ss"))),
        iso_ts(F.nullif(F.regexp_extract(line, ISO_STAMP, 1), F.lit(""))),
    )


def after_syslog_ts(line: Column) -> Column:
    """The line without its leading timestamp."""
    return F.trim(F.regexp_replace(line, f"{SYSLOG_STAMP}|{ISO_STAMP}", ""))


def micros(c: Column) -> Column:
    return F.unix_micros(c)
