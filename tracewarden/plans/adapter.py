"""The test tables as telemetry: a fixed mapping of the generic ``events`` table to universal events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import fixed


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return universal(load(spark, folder, "events"))


def universal(raw: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) -> flat universal events."""
    # A column of its own, so that the JSON is parsed once for a row and not once for each use.
    raw, k = raw.withColumn("_k", F.get_json_object("props", "$.k").cast("int")), F.col("_k")
    user = F.col("user_id").cast("string")
    who = F.array(F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")), F.concat(F.lit("svc_"), user), F.concat(F.lit("user-"), user))
    kind_of_user = F.coalesce(F.create_map(F.lit(0), F.lit(0), F.lit(1), F.lit(1))[k % 11], F.lit(2))
    b = raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(k % 5 < 3, "windows").when(k % 5 == 3, "linux").otherwise("network").alias("platform"),
        F.concat(F.lit("host-"), (k % 20).cast("string")).alias("source"),
        who[kind_of_user].alias("actor"),
        F.when(F.col("event_type") == "error", 4625).when(F.col("event_type") == "click", 4624)
        .when(F.col("event_type") == "signup", 4732)
        .when(F.col("event_type") == "purchase", F.when(k % 2 == 0, 7045).otherwise(4698))
        .otherwise(F.when(k % 3 == 0, 1102).when(k % 3 == 1, 4720).otherwise(5140)).alias("raw_event_id"),
        F.col("props").alias("raw_payload"),
    )
    # Looked up, as the kind of user is, so that a filter pushed through them holds the number once and not once for each value.
    def told(names: dict, other: str | int) -> Column:
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.coalesce(known[F.col("raw_event_id")], F.lit(other))

    seen = {n: fixed.WINDOWS_EVENTS[n] for n in (4625, 4624, 4732, 7045, 4698, 1102, 4720)}
    about = told({n: e[0] for n, e in seen.items()}, "Network share object accessed")
    score = told({n: e[1] for n, e in seen.items()}, 5)
    kind = told({4624: "auth", 4625: "auth", 4698: "process", 5140: "network"}, "config")
    return b.select(
        "event_id", "timestamp", "platform", "source", "actor", F.col("source").alias("target"),
        kind.alias("event_type"), score.alias("severity"), "raw_event_id", about.alias("description"),
        F.lit("").alias("mitre_technique"), F.lit("").alias("mitre_tactic"), "raw_payload",
    )
