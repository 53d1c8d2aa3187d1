"""Table shapes of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Nested wire form of one event (JSON).
EVENT_JSON = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("mitre", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

# Flat form, one row per event: what every operator takes and returns.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("platform", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("raw_event_id", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
        T.StructField("mitre_tactic", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

# Parsed Windows record, before normalisation; every Windows source produces it.
WINDOWS_RAW = T.StructType(
    [
        T.StructField("raw_event_id", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("computer", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("subject_user", T.StringType()),
        T.StructField("target_user", T.StringType()),
        T.StructField("logon_type", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
    ]
)

ALERT_COLUMNS = [
    "alert_id", "timestamp", "alert_type", "severity", "severity_score", "title", "description", "actor", "target",
    "source_host", "event_id", "event_ids", "sigma_rule_id", "mitre_technique", "mitre_tactic", "metadata", "stage",
    "status",
]
