"""Filtered search, paging, point lookups and live views over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import predicates as p
from tracewarden.functions.times import instant


def _like(column: str, text: str) -> Column:
    """Case-insensitive substring; % and _ in the text stay wildcards."""
    return F.col(column).ilike(f"%{text}%")


def _where(df: DataFrame, conds: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def page(df: DataFrame, limit: int, offset: int = 0, *order: Column) -> DataFrame:
    """One page of an ordered result."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """total, limit, offset and has_more of a result, as one row."""
    total = F.count("*")
    return df.agg(
        total.alias("total"), F.lit(limit).cast("long").alias("limit"), F.lit(offset).cast("long").alias("offset"),
        (total > offset + limit).alias("has_more"),
    )


def match_events(
    df: DataFrame, platform: str | None = None, source: str | None = None, actor: str | None = None,
    event_type: str | None = None, severity_min: int = 0, since=None, until=None, search: str | None = None,
) -> DataFrame:
    """Events passing every given filter. Equality and range filters reach the Parquet scan."""
    conds = []
    if platform:
        conds.append(F.col("platform") == platform)
    if event_type:
        conds.append(F.col("event_type") == event_type)
    if severity_min > 0:
        conds.append(F.col("severity") >= severity_min)
    if since is not None:
        conds.append(F.col("timestamp") >= instant(since))
    if until is not None:
        conds.append(F.col("timestamp") <= instant(until))
    if source:
        conds.append(_like("source", source))
    if actor:
        conds.append(_like("actor", actor))
    if search:
        conds.append(_like("description", search) | _like("actor", search) | _like("raw_payload", search))
    return _where(df, conds)


def search_events(df: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Newest first, one page."""
    return page(match_events(df, **filters), limit, offset, F.desc("timestamp"), F.col("event_id"))


def window_scan(df: DataFrame, since, until, actor: str | None = None, source: str | None = None) -> DataFrame:
    conds = [F.col("timestamp").between(instant(since), instant(until))]
    if actor:
        conds.append(F.col("actor") == actor)
    if source:
        conds.append(F.col("source") == source)
    return _where(df, conds).orderBy("timestamp", "event_id")


def recent(df: DataFrame, count: int = 100, arrival: str = "timestamp") -> DataFrame:
    """The last events by arrival, newest first."""
    return df.orderBy(F.desc(arrival), F.desc("event_id")).limit(count)


def live_search(
    df: DataFrame, limit: int = 500, buffer: int = 50_000, arrival: str = "timestamp", platform: str | None = None,
    source: str | None = None, actor: str | None = None, event_type: str | None = None, severity_min: int = 0,
    since=None, search: str | None = None,
) -> DataFrame:
    """Search among the last ``buffer`` events by arrival. Text is matched literally; an unreadable time passes."""
    conds = []
    if platform:
        conds.append(p.on_platform(platform))
    if source:
        conds.append(p.source_contains(source))
    if actor:
        conds.append(p.actor_contains(actor))
    if event_type:
        conds.append(F.col("event_type") == event_type)
    if severity_min > 0:
        conds.append(p.min_severity(severity_min))
    if since is not None:
        conds.append(F.coalesce(F.col("timestamp") >= instant(since), F.lit(True)))
    if search:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("source", "actor", "description", "raw_payload")]))
        conds.append(text.contains(search.lower()))
    return recent(_where(recent(df, buffer, arrival), conds), limit, arrival)


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup in any table."""
    return df.filter(F.col(key) == value)


def alert_five_w(narrated: DataFrame, alert_id: str) -> DataFrame:
    return by_id(narrated, "alert_id", alert_id).select("alert_id", "five_w")


def match_entities(
    df: DataFrame, type: str | None = None, risk_min: float = 0.0, is_stale: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    conds = []
    if type:
        conds.append(F.col("entity_type") == type)
    if risk_min > 0:
        conds.append(F.col("risk_score") >= risk_min)
    if is_stale is not None:
        conds.append(F.col("is_stale") == is_stale)
    if search:
        conds.append(_like("entity_id", search))
    return _where(df, conds)


def search_entities(df: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return page(match_entities(df, **filters), limit, offset, F.desc("risk_score"), F.desc("last_seen"), F.col("entity_id"))


def find_entities(df: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities whose id contains the literal text, riskiest first."""
    hits = df.filter(F.lower("entity_id").contains(text.lower()))
    return hits.orderBy(F.desc("risk_score"), "entity_id").limit(limit)


def match_alerts(
    df: DataFrame, severity: str | None = None, status: str | None = None, actor: str | None = None,
    alert_type: str | None = None, since=None,
) -> DataFrame:
    conds = []
    if severity:
        conds.append(F.col("severity") == severity)
    if status:
        conds.append(F.col("status") == status)
    if alert_type:
        conds.append(F.col("alert_type") == alert_type)
    if since is not None:
        conds.append(F.col("timestamp") >= instant(since))
    if actor:
        conds.append(_like("actor", actor))
    return _where(df, conds)


def search_alerts(df: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Most severe first, then newest."""
    return page(match_alerts(df, **filters), limit, offset, F.desc("severity_score"), F.desc("timestamp"), F.col("alert_id"))


def alert_feed(df: DataFrame, as_of, since=None, limit: int = 50) -> DataFrame:
    """Open alerts of the last day, or since a given time."""
    start = instant(since) if since is not None else instant(as_of) - F.make_dt_interval(hours=F.lit(24))
    return search_alerts(df, limit, status="open", since=start)


def list_cases(df: DataFrame, limit: int = 50, offset: int = 0, status: str | None = None) -> DataFrame:
    used = df.filter(F.col("status") == status) if status else df
    return page(used, limit, offset, F.desc("created_at"), F.col("investigation_id"))


def timeline_of(df: DataFrame, entity_id: str, since=None, limit: int = 200) -> DataFrame:
    """The timeline of one entity, newest first."""
    used = df.filter(F.col("entity_id") == entity_id)
    if since is not None:
        used = used.filter(F.col("timestamp") >= instant(since))
    return used.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def entity_events(df: DataFrame, entity_id: str, limit: int = 100, since=None) -> DataFrame:
    return search_events(df, limit, actor=entity_id, since=since)


def entity_alerts(df: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    return search_alerts(df, limit, actor=entity_id)
