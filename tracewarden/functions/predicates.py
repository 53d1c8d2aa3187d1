"""Event predicates as Columns. Each is never null, so it can be negated safely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions import fixed


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def on_platform(name: str) -> Column:
    return _sure(F.col("platform") == name)


def windows_events() -> Column:
    return on_platform("windows")


def min_severity(n: int) -> Column:
    return F.coalesce(F.col("severity"), F.lit(0)) >= n


def high_severity() -> Column:
    return min_severity(7)


def actor_contains(text: str) -> Column:
    return _sure(F.lower("actor").contains(text.lower()))


def source_contains(text: str) -> Column:
    return _sure(F.lower("source").contains(text.lower()))


def auth_events() -> Column:
    return _sure(F.col("event_type") == "auth")


def critical_events() -> Column:
    return _sure(F.col("raw_event_id").isin(fixed.CRITICAL_IDS)) | min_severity(9)


def subscription(platform: str | None = None, severity_min: int = 0) -> Column:
    """Filter of a live subscription."""
    keep = F.lit(True)
    if platform:
        keep = keep & on_platform(platform)
    if severity_min > 0:
        keep = keep & min_severity(severity_min)
    return keep


def _auth_saying(word: str) -> Column:
    return auth_events() & _sure(F.lower("description").contains(word))


def _id_is(*ids: int) -> Column:
    return _sure(F.col("raw_event_id").isin(list(ids)))


def failed_auth() -> Column:
    return _id_is(fixed.FAILED_LOGON) | _auth_saying("fail")


def successful_auth() -> Column:
    return _id_is(fixed.LOGON) | _auth_saying("success")


def any_auth() -> Column:
    return _id_is(fixed.LOGON) | auth_events()


def windows_logon() -> Column:
    return _id_is(fixed.LOGON)


def group_add() -> Column:
    return _id_is(*fixed.GROUP_ADD)


def service_installed() -> Column:
    return _id_is(*fixed.SERVICE_INSTALLED)


def task_created() -> Column:
    return _id_is(fixed.TASK_CREATED)


def account_created() -> Column:
    return _id_is(fixed.ACCOUNT_CREATED)


def log_cleared() -> Column:
    return _id_is(fixed.LOG_CLEARED)


def is_monitored(c: Column) -> Column:
    return _sure(c.isin(fixed.MONITORED_IDS))
