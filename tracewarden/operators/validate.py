"""Validation, sanitising and the nested/flat forms of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import fixed
from tracewarden.functions.text import blank, or_unknown
from tracewarden.functions.times import instant, iso_ts
from tracewarden.schema import EVENT_COLUMNS, EVENT_JSON


def parse_event_json(df: DataFrame, as_of, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON text -> (valid flat events, rejected rows with ``reason``). Works on batch and streaming input.

    A required field has to be there; null is repaired like any bad value, and an event whose id is null keeps none.
    """
    read = F.from_json(col, EVENT_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # The filters below must not be pushed into the reading, which would repeat it per field: an explode is a barrier.
    parsed = df.withColumn("_e", F.explode(F.array(read)))
    e = F.col("_e")
    reason = F.when(e.isNull() | e["_corrupt_record"].isNotNull(), "invalid json")
    for name in fixed.REQUIRED_FIELDS:
        # A field that is there but null is repaired later; the keys are read only where a value is null.
        absent = e[name].isNull() & ~F.coalesce(F.array_contains(F.json_object_keys(col), name), F.lit(False))
        reason = reason.when(absent, f"missing required field: {name}")
    flagged = parsed.withColumn("reason", reason)
    valid = flagged.filter("reason IS NULL").select("*", "_e.*").drop(col, "reason", "_e", "_corrupt_record")
    return flatten(_fix(valid, as_of)), flagged.filter("reason IS NOT NULL").select(F.col(col), "reason")


def validate(df: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """The same rules on a DataFrame whose columns are the nested event fields (sub-objects as JSON text). Here null means absent."""
    missing = F.lit(None)
    for name in reversed(fixed.REQUIRED_FIELDS):
        missing = F.when(F.col(name).isNull(), f"missing required field: {name}").otherwise(missing)
    flagged = df.withColumn("reason", missing)
    return (
        flatten(_fix(flagged.filter("reason IS NULL").drop("reason"), as_of)),
        flagged.filter("reason IS NOT NULL"),
    )


_PARTS = {
    "entity": "actor string, target string",
    "event": "type string, severity string, raw_event_id string, description string",
    "mitre": "technique_id string, tactic_name string",
}


def _fix(df: DataFrame, as_of) -> DataFrame:
    """Repair what can be repaired; a sub-object that is not an object takes its defaults."""
    # Each sub-object is read once. A severity in quotes must be an integer; a bare number may have a fraction, which
    # is cut.
    quoted = F.coalesce(F.col("event").rlike(r'"severity"\s*:\s*"'), F.lit(False)).alias("_quoted")
    df = df.select("*", quoted, *[
        F.when(F.trim(name).startswith("{"), F.from_json(name, fields)).alias(f"_{name}") for name, fields in _PARTS.items()
    ])

    def part(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    sev = F.col("_event.severity")
    number = F.when(F.col("_quoted"), F.trim(sev).try_cast("int")).otherwise(sev.try_cast("double").cast("int"))
    has_event = F.col("_event").isNotNull()
    platform = F.lower("platform")
    return df.select(
        "event_id",
        F.coalesce(iso_ts(F.col("timestamp")), instant(as_of)).alias("timestamp"),
        F.when(platform.isin(fixed.PLATFORMS), platform).otherwise("unknown").alias("platform"),
        or_unknown(F.col("source")).alias("source"),
        F.struct(part("_entity.actor", "unknown").alias("actor"), part("_entity.target", "unknown").alias("target"))
        .alias("entity"),
        F.struct(
            F.when(has_event, part("_event.type", "system")).otherwise("unknown").alias("type"),
            F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(number, F.lit(1)))).alias("severity"),
            F.coalesce(F.col("_event.raw_event_id").try_cast("int"), F.lit(0)).alias("raw_event_id"),
            part("_event.description", "").alias("description"),
        ).alias("event"),
        F.struct(part("_mitre.technique_id", "").alias("technique_id"), part("_mitre.tactic_name", "").alias("tactic_name"))
        .alias("mitre"),
        F.coalesce("raw_payload", F.lit("")).alias("raw_payload"),
    )


def flatten(df: DataFrame) -> DataFrame:
    """Nested event structs -> the flat event table."""
    return df.select(
        "event_id", "timestamp", F.coalesce("platform", F.lit("unknown")).alias("platform"),
        or_unknown(F.col("source")).alias("source"),
        or_unknown(F.col("entity.actor")).alias("actor"),
        or_unknown(F.col("entity.target")).alias("target"),
        F.coalesce(F.col("event.type"), F.lit("system")).alias("event_type"),
        F.coalesce(F.col("event.severity"), F.lit(1)).cast("int").alias("severity"),
        F.col("event.raw_event_id").cast("int").alias("raw_event_id"),
        F.col("event.description").alias("description"),
        F.col("mitre.technique_id").alias("mitre_technique"),
        F.col("mitre.tactic_name").alias("mitre_tactic"),
        F.coalesce("raw_payload", F.lit("")).alias("raw_payload"),
    )


def nest(df: DataFrame) -> DataFrame:
    """The flat event table -> nested wire form."""
    return df.select(
        "event_id", "timestamp", "platform", "source",
        F.struct("actor", "target").alias("entity"),
        F.struct(F.col("event_type").alias("type"), "severity", "raw_event_id", "description").alias("event"),
        F.struct(F.col("mitre_technique").alias("technique_id"), F.col("mitre_tactic").alias("tactic_name"))
        .alias("mitre"),
        "raw_payload",
    )


def to_json_lines(df: DataFrame) -> DataFrame:
    """The flat event table -> one JSON text per event."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return nest(df).withColumn("timestamp", stamp).select(F.to_json(F.struct("*")).alias("value"))


def sanitise_events(df: DataFrame) -> DataFrame:
    """Cut over-long fields; characters, not bytes."""
    lengths = {
        "source": fixed.MAX_SOURCE, "raw_payload": fixed.MAX_PAYLOAD, "actor": fixed.MAX_ACTOR,
        "target": fixed.MAX_ACTOR, "description": fixed.MAX_DESCRIPTION,
    }
    return df.withColumns({c: F.left(c, F.lit(n)) for c, n in lengths.items()})


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill the columns a stored event must have."""
    defaults = {
        "platform": "unknown", "source": "unknown", "actor": "unknown", "target": "unknown", "event_type": "system",
        "severity": 1, "raw_payload": "",
    }
    for name in EVENT_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("int" if name in ("severity", "raw_event_id") else "string"))
    df = df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in ("severity", "raw_payload", "platform", "event_type")
        else F.when(blank(F.col(c)), v).otherwise(F.col(c))
        for c, v in defaults.items()
    })
    return df.select(*EVENT_COLUMNS)
