"""Counts that are kept beside the events, so that reports read them instead of all events.

Each batch of events adds one folder of counts: by (minute, platform, type, severity), by (day, source) and by (day, actor), in one pass
over the batch. Counts of a minute add up over batches, so rows may come late by any amount. ``compact`` folds the batches into one
base. What a report needs of part of a minute is counted on the events of that minute, so its rows are those of ``reports``
on all events.

Folders count for readers once their commit exists; a batch that is repeated replaces what an earlier attempt wrote, and a batch that
is committed is left alone. Batch ids rise, as those of ``foreachBatch`` do. Events without a time are counted, in no minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.text import severity_name
from tracewarden.functions.times import instant
from tracewarden.operators.reports import BUCKETS
from tracewarden.sources.arrivals import _fs, _names

COUNTS = "minute timestamp, platform string, event_type string, severity int, name string, count bigint"
KINDS = ("cube", "source", "actor")


def counted(events: DataFrame) -> DataFrame:
    """The counts of some events, one row per kind and key; combined map-side."""
    minute, day = F.date_trunc("minute", "timestamp"), F.date_trunc("day", "timestamp")
    rows = events.select("platform", "event_type", "severity", "source", "actor", minute.alias("minute"), day.alias("day"))
    cube, source, actor = ["minute", "platform", "event_type", "severity"], ["day", "source"], ["day", "actor"]
    keys = ["minute", "day", "platform", "event_type", "severity", "source", "actor"]
    sums = rows.groupingSets([[F.col(c) for c in s] for s in (cube, source, actor)], *keys).agg(
        F.count("*").alias("count"), F.grouping("source").alias("_no_source"), F.grouping("actor").alias("_no_actor"))
    kind = F.when(F.col("_no_source") == 0, "source").when(F.col("_no_actor") == 0, "actor").otherwise("cube")
    return sums.select(kind.alias("kind"), F.when(kind == "cube", F.col("minute")).otherwise(F.col("day")).alias("minute"), "platform",
                       "event_type", "severity", F.when(kind == "source", F.col("source")).when(kind == "actor", F.col("actor")).alias("name"), "count")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _state(self) -> tuple[int, list[int]]:
        """The newest base (-1: none) and the batches after it."""
        done = [n.split("-") for n in _names(self.spark, f"{self.path}/commits") if "-" in n and not n.startswith(".")]
        base = max((int(n) for kind, n in done if kind == "base"), default=-1)
        return base, sorted(int(n) for kind, n in done if kind == "delta" and int(n) > base)

    def _store(self, rows: DataFrame, kind: str, number: int) -> None:
        ordered = rows.repartitionByRange("kind", "minute", "name").sortWithinPartitions("kind", "minute", "name")
        ordered.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{self.path}/{kind}-{number}")
        fs, marker = _fs(self.spark, f"{self.path}/commits/{kind}-{number}")
        fs.create(marker, True).close()

    def append(self, events: DataFrame, batch_id: int) -> None:
        base, deltas = self._state()
        if batch_id > base and batch_id not in deltas:
            self._store(counted(events), "delta", batch_id)

    def follow(self, events: DataFrame, checkpoint: str, compact_every: int = 50, **trigger):
        """Keep the counts of a stream of events."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if (batch_id + 1) % compact_every == 0:
                self.compact()

        return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def compact(self) -> None:
        """Fold everything committed into a new base. What the base before it replaced is removed, so that running reports finish."""
        base, deltas = self._state()
        if not deltas:
            return
        rows = None
        for kind in KINDS:
            part = self.counts(kind).withColumn("kind", F.lit(kind))
            rows = part if rows is None else rows.unionByName(part)
        keys = [c for c in rows.columns if c != "count"]
        self._store(rows.groupBy(*keys).agg(F.sum("count").alias("count")), "base", deltas[-1])
        for name in _names(self.spark, f"{self.path}/commits"):
            kind, _, number = name.partition("-")
            if number.isdigit() and (int(number) < base or kind == "delta" and int(number) == base):
                for old in (f"{self.path}/commits/{name}", f"{self.path}/{name}"):
                    fs, target = _fs(self.spark, old)
                    fs.delete(target, True)

    def counts(self, kind: str) -> DataFrame:
        """The counts of a kind; a key may have several rows, which add up."""
        base, deltas = self._state()
        folders = ([f"{self.path}/base-{base}"] if base >= 0 else []) + [f"{self.path}/delta-{d}" for d in deltas]
        there = [f"{f}/kind={kind}" for f in folders if f"kind={kind}" in _names(self.spark, f)]
        if not there:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*there)

    # ---- Reports, with the columns and rows of ``reports`` ----

    def between(self, events: DataFrame, since: Column, until: Column, closed: bool) -> DataFrame:
        """Counts by minute, platform, type and severity of a time range (``closed``: with its end). Only the minutes at its ends
        are read from ``events``."""
        first = F.date_trunc("minute", since + F.expr("INTERVAL 59.999999 SECONDS"))  # the first whole minute
        last = F.date_trunc("minute", until)
        inside = self.counts("cube").filter((F.col("minute") >= first) & (F.col("minute") < last)).drop("name")
        at = F.col("timestamp")
        wanted = (at >= since) & ((at <= until) if closed else (at < until))
        edge = events.filter(wanted & ((at < first) | (at >= last))).groupBy(
            F.date_trunc("minute", "timestamp").alias("minute"), "platform", "event_type", F.col("severity").cast("int").alias("severity")
        ).agg(F.count("*").alias("count"))
        return inside.unionByName(edge)

    def timeline(self, events: DataFrame, as_of, bucket: str = "hour", since=None, until=None, platform: str | None = None) -> DataFrame:
        until = instant(as_of if until is None else until)
        since = instant(as_of) - F.make_dt_interval(hours=F.lit(24)) if since is None else instant(since)
        used = self.between(events, since, until, True)
        used = used.filter(F.col("platform") == platform) if platform else used
        return used.groupBy(F.date_trunc(bucket if bucket in BUCKETS else "hour", "minute").alias("bucket")).agg(
            F.sum("count").alias("count"), F.max("severity").alias("max_severity")).orderBy("bucket")

    def count_by(self, field: str) -> DataFrame:
        """By platform, event_type or severity."""
        name = F.coalesce(F.col(field).cast("string"), F.lit("unknown"))
        return self.counts("cube").groupBy(name.alias(field)).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), field)

    def severity_histogram(self) -> DataFrame:
        return self.counts("cube").groupBy(severity_name(F.col("severity")).alias("level")).agg(
            F.sum("count").alias("count")).orderBy(F.desc("count"), "level")

    def top_by(self, field: str, limit: int = 10) -> DataFrame:
        """By source or actor."""
        named = self.counts(field).filter("name IS NOT NULL AND name != 'unknown'")
        return named.groupBy(F.col("name").alias(field)).agg(F.sum("count").alias("event_count")).orderBy(F.desc("event_count"), field).limit(limit)

    def dashboard(self, events: DataFrame, as_of, top: int = 10) -> DataFrame:
        """(measure, name, count), as ``reports.dashboard``."""
        since = instant(as_of) - F.make_dt_interval(hours=F.lit(1))
        newest = F.lit("9999-12-31").cast("timestamp")
        total = lambda df, name: df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(
            F.lit(name).alias("measure"), F.lit("").alias("name"), "count")
        out = total(self.counts("cube"), "total_events").unionByName(total(self.between(events, since, newest, False), "events_last_hour"))
        parts = [(f, self.count_by(f), f, "count") for f in ("platform", "event_type")]
        parts += [("level", self.severity_histogram(), "level", "count")]
        parts += [(f"top_{f}", self.top_by(f, top), f, "event_count") for f in ("source", "actor")]
        for measure, df, name, count in parts:
            out = out.unionByName(df.select(F.lit(measure).alias("measure"), F.coalesce(name, F.lit("unknown")).alias("name"), F.col(count).alias("count")))
        return out
