"""Aggregated reports over events, entities and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import severity_name
from tracewarden.functions.times import instant

BUCKETS = ("minute", "hour", "day")


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row aggregates side by side: stacked, then folded, so nothing is joined."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def totals(
    events: DataFrame, alerts: DataFrame, entities: DataFrame, rules_active: int, cases: DataFrame | None, as_of
) -> DataFrame:
    """System totals as one row."""
    recent = F.col("timestamp") >= instant(as_of) - F.make_dt_interval(hours=F.lit(1))
    parts = [
        events.agg(F.count("*").alias("events_total"), F.count_if(recent).alias("events_last_hour")),
        alerts.agg(F.count("*").alias("alerts_total"), F.count_if(F.col("status") == "open").alias("alerts_open")),
        entities.agg(F.count("*").alias("entities_total")),
    ]
    if cases is not None:
        parts.append(cases.agg(F.count_if(F.col("status") != "closed").alias("investigations_open")))
    return _one_row(*parts).withColumn("rules_active", F.lit(rules_active).cast("long"))


def count_by(events: DataFrame, field: str) -> DataFrame:
    return events.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias(field)).agg(
        F.count("*").alias("count")
    ).orderBy(F.desc("count"), field)


def severity_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(severity_name(F.col("severity")).alias("level")).agg(
        F.count("*").alias("count")
    ).orderBy(F.desc("count"), "level")


def top_by(events: DataFrame, field: str, limit: int = 10) -> DataFrame:
    return (
        events.filter(F.col(field).isNotNull() & (F.col(field) != "unknown"))
        .groupBy(field).agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), field).limit(limit)
    )


def timeline(events: DataFrame, as_of, bucket: str = "hour", since=None, until=None, platform: str | None = None) -> DataFrame:
    """Event count and highest severity per time bucket; by default the day before ``as_of``."""
    until = instant(as_of if until is None else until)
    since = instant(as_of) - F.make_dt_interval(hours=F.lit(24)) if since is None else instant(since)
    used = events.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= until))
    if platform:
        used = used.filter(F.col("platform") == platform)
    unit = bucket if bucket in BUCKETS else "hour"
    return used.groupBy(F.date_trunc(unit, "timestamp").alias("bucket")).agg(
        F.count("*").alias("count"), F.max("severity").alias("max_severity")
    ).orderBy("bucket")


def _measure(df: DataFrame, measure: str, name) -> DataFrame:
    return df.select(F.lit(measure).alias("measure"), name.alias("name"), "count")


def alert_stats(alerts: DataFrame, as_of, top_types: int = 20) -> DataFrame:
    """(measure, name, count): by severity, most frequent types, by status, and the last day."""
    cube = alerts.groupBy("severity", "alert_type", "status").agg(
        F.count("*").alias("count"),
        F.count_if(F.col("timestamp") >= instant(as_of) - F.make_dt_interval(hours=F.lit(24))).alias("recent"),
    )
    types = cube.groupBy("alert_type").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "alert_type").limit(top_types)
    return (
        _measure(cube.groupBy("severity").agg(F.sum("count").alias("count")), "severity", F.col("severity"))
        .unionByName(_measure(types, "type", F.col("alert_type")))
        .unionByName(_measure(cube.groupBy("status").agg(F.sum("count").alias("count")), "status", F.col("status")))
        .unionByName(_measure(cube.agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("count")), "last_24h", F.lit("")))
    )


def dashboard(events: DataFrame, as_of, top: int = 10) -> DataFrame:
    """(measure, name, count): totals, platforms, types, severities, busiest sources and actors.

    One small cube over (platform, type, severity) answers totals and breakdowns; sources and actors, which can be
    many, are counted on their own columns only. Every count is combined map-side.
    """
    recent = F.col("timestamp") >= instant(as_of) - F.make_dt_interval(hours=F.lit(1))
    cube = events.groupBy("platform", "event_type", severity_name(F.col("severity")).alias("level")).agg(
        F.count("*").alias("count"), F.count_if(recent).alias("recent")
    )

    def over(field: str) -> DataFrame:
        grouped = cube.groupBy(F.coalesce(F.col(field), F.lit("unknown")).alias("name")).agg(F.sum("count").alias("count"))
        return _measure(grouped, field, F.col("name"))

    def busiest(field: str) -> DataFrame:
        return _measure(
            top_by(events, field, top).withColumnRenamed("event_count", "count"), f"top_{field}", F.col(field))

    whole = cube.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent"))
    sums = whole.select(F.explode(F.create_map(
        F.lit("total_events"), "all", F.lit("events_last_hour"), "recent")).alias("measure", "count"))
    out = sums.select("measure", F.lit("").alias("name"), "count")
    for part in (over("platform"), over("event_type"), over("level"), busiest("source"), busiest("actor")):
        out = out.unionByName(part)
    return out


def ingest_counters(received: DataFrame, rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """received, rejected, processed and duplicate counts of an ingest, as one row."""
    out = _one_row(
        received.agg(F.count("*").alias("received")), rejected.agg(F.count("*").alias("rejected")),
        stored.agg(F.count("*").alias("processed")),
    )
    return out.withColumn("duplicates", F.col("received") - F.col("rejected") - F.col("processed"))
