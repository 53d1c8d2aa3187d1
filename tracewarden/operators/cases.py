"""Alert status and investigation cases as append-only logs; the current state is derived.

Log of alerts:   alert_id, at, status, by
Log of cases:    investigation_id, at, action, and per action: title, description, severity, assigned_to,
                 alert_ids, event_ids (create); status (status); content, author, note_type (note);
                 alert_ids (attach)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_STATUS = ("open", "acknowledged", "resolved", "false_positive")
CASE_STATUS = ("open", "in_progress", "closed")


def alert_state(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with their current status and who acknowledged or resolved them, and when."""
    used = log.filter(F.col("status").isin(*ALERT_STATUS))
    latest = used.groupBy("alert_id").agg(
        F.max_by("status", "at").alias("_status"),
        F.max_by(F.col("by"), F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_by"),
        F.max(F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("status") == "resolved", F.col("at"))).alias("resolved_at"),
    )
    return alerts.join(latest, "alert_id", "left").withColumn(
        "status", F.coalesce("_status", "status") if "status" in alerts.columns else F.coalesce("_status", F.lit("open"))
    ).drop("_status")


def cases(log: DataFrame) -> DataFrame:
    """One row per investigation that was created, with its current state."""
    status = (F.col("action") == "status") & F.col("status").isin(*CASE_STATUS)
    created = F.col("action") == "create"

    def at_creation(name: str):
        return F.max_by(F.col(name), F.when(created, F.col("at"))).alias(name)

    state = log.groupBy("investigation_id").agg(
        *[at_creation(c) for c in ("title", "description", "severity", "assigned_to", "event_ids")],
        F.max_by("status", F.when(status, F.col("at"))).alias("_status"),
        F.min(F.when(created, F.col("at"))).alias("created_at"),
        F.max("at").alias("updated_at"),
        F.max(F.when(status & (F.col("status") == "closed"), F.col("at"))).alias("closed_at"),
    ).filter("created_at IS NOT NULL")
    state = state.join(case_alerts(log), "investigation_id", "left")
    return state.select(
        "investigation_id", "title", "description", F.coalesce("_status", F.lit("open")).alias("status"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), "assigned_to", "alert_ids",
        F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"), "created_at", "updated_at", "closed_at",
    )


def case_notes(log: DataFrame) -> DataFrame:
    """Notes of each case, oldest first, equal times by content; written by people, so lists stay short."""
    note = F.struct(
        F.col("at").alias("timestamp"), "content",
        F.sha2(F.concat_ws("\u0001", "investigation_id", F.col("at").cast("string"), "content"), 256).alias("id"),
        "author", "note_type",
    )
    return log.filter("action = 'note'").groupBy("investigation_id").agg(F.array_sort(F.collect_list(note)).alias("notes"))


def case_alerts(log: DataFrame) -> DataFrame:
    """The set of alerts of each case: those it was created with and those attached later."""
    ids = log.filter(F.col("action").isin("create", "attach")).select(
        "investigation_id", F.explode("alert_ids").alias("alert_id")).distinct()
    listed = ids.groupBy("investigation_id").agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    return log.select("investigation_id").distinct().join(listed, "investigation_id", "left").withColumn(
        "alert_ids", F.coalesce("alert_ids", F.array().cast("array<string>")))


def case_contents(state: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """The alerts and events of each case in order of time."""
    of_alerts = state.select("investigation_id", F.explode("alert_ids").alias("alert_id")).join(
        alerts.select("alert_id", "timestamp", F.col("alert_type").alias("about"), "actor"), "alert_id")
    of_events = state.select("investigation_id", F.explode("event_ids").alias("event_id")).join(
        events.select("event_id", "timestamp", F.col("description").alias("about"), "actor"), "event_id")
    return of_alerts.select(
        "investigation_id", "timestamp", F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "about", "actor"
    ).unionByName(of_events.select(
        "investigation_id", "timestamp", F.lit("event").alias("kind"), F.col("event_id").alias("id"), "about", "actor"))
