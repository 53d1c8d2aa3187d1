"""Structured Streaming: the stateless operators run on a stream as they are; this module adds what needs state.

Window rules on a stream. An exact sliding window per event is not an aggregate Spark keeps on a stream, and a keyed
Python state would put a busy actor into one task. So a frontier follows event time (highest time seen minus the
allowed lateness), and in every micro-batch the batch detectors run over the rows the frontier has just passed plus one
window of context. Skew handling, cooldown and results are those of batch.

What later batches need expires by event time: each batch writes the rows of the last window and the alerts of the last
cooldown as a state of its own, the next batch reads that one and older ones are removed. So a batch reads and lists as
much after a year as after a minute. Each step writes to a folder named by the batch id and overwrites it on a retry, so a
repeated micro-batch leaves one copy. See ``streaming.entities`` for risk, snapshots and timelines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import predicates as p
from tracewarden.operators import correlate as c
from tracewarden.operators import entities as e
from tracewarden.operators.narrative import five_w
from tracewarden.operators.sigma import RulePack, sigma_match
from tracewarden.operators.sliding import SECOND
from tracewarden.session import reliable

FRONTIER = "frontier long, late long"
START = -(2**62)
COOLING = [*c.COOLDOWN_KEYS, "timestamp", "event_id", "stage"]
FOLD = 20  # batches after which the notes on actors are folded


def dedup_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """First row per event_id; ids are remembered for the lateness only."""
    return events.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def subscribe(events: DataFrame, platform: str | None = None, severity_min: int = 0) -> DataFrame:
    """The live feed of a subscriber."""
    return events.filter(p.subscription(platform, severity_min))


def timeline_stream(events: DataFrame, bucket: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Event count and highest severity per time bucket; a bucket is emitted once it can no longer change."""
    grouped = events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", bucket).alias("w"), "platform")
    return grouped.agg(F.count("*").alias("count"), F.max("severity").alias("max_severity")).select(
        F.col("w.start").alias("bucket"), "platform", "count", "max_severity")


class LiveDetection:
    """All detectors over a stream of events, with cooldown, into ``folder``/alerts.

    ``entity`` holds arguments of entities.deviations, ``rules`` those of correlate.correlate. What deviations need to
    know of the past is kept as one row per actor, and per actor and source, of each batch.
    """

    def __init__(
        self, spark: SparkSession, folder: str, pack: RulePack | None = None, window_s: int = 600, cooldown_s: int = 300,
        lateness_s: int = 0, entity: dict | None = None, **rules,
    ):
        self.entity = dict(entity or {})
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self.pack = RulePack.builtin() if pack is None else pack
        self.window_s, self.cooldown_s, self.lateness_s = window_s, cooldown_s, lateness_s

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """Run as a streaming query; ``trigger`` as in writeStream.trigger, by default a batch every two seconds."""
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Store the rows, move the frontier, and examine what it passed.

        Rows that the frontier has passed already, or without a time, are stored as late ones and not examined.
        """
        done, late = self._frontier(batch_id)
        batch = reliable(batch)
        us = F.unix_micros("timestamp")
        seen = batch.agg(F.max(us).alias("newest"), F.count_if(us <= done).alias("late")).first()
        dated = batch.withColumn("event_date", F.to_date("timestamp"))
        in_time = F.coalesce(us > done, F.lit(False))
        self._write(dated.filter(in_time), "events", batch_id, "event_date")
        self._write(dated.filter(~in_time), "late", batch_id)
        newest = seen["newest"]
        upto = done if newest is None else max(done, newest - self.lateness_s * SECOND)
        carried = self._state("context", batch_id)
        rows = batch.filter(in_time)
        rows = rows if carried is None else carried.select(*rows.columns).unionByName(rows)
        self._advance(batch_id, rows, done, upto, late + (seen["late"] or 0))

    def flush(self, batch_id: int) -> None:
        """Examine everything stored, when no more rows will come."""
        done, late = self._frontier(batch_id)
        rows = self._state("context", batch_id)
        newest = None if rows is None else rows.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if rows is not None:
            self._advance(batch_id, rows, done, done if newest is None else max(done, newest), late)

    def alerts(self) -> DataFrame:
        return self._read("alerts").drop("batch_id")

    def narrated(self, as_of) -> DataFrame:
        """The alerts with their narratives; "now" is ``as_of``."""
        return five_w(self.alerts(), as_of)

    def events(self) -> DataFrame:
        """Every row that came, late or not."""
        return self._read("events").unionByName(self._read("late"), allowMissingColumns=True).drop("batch_id")

    def late_rows(self) -> DataFrame:
        """How many rows came after the frontier had passed them."""
        return self._state("frontier", 2**62).select("late")

    # ---- steps ----

    def _advance(self, batch_id: int, rows: DataFrame, done: int, upto: int, late: int) -> None:
        us = F.unix_micros("timestamp")
        rows = reliable(rows)
        old = self._state("cooling", batch_id)
        if upto > done:
            alerts = self._examine(batch_id, rows.filter(us <= upto), old, done)
            self._write(alerts, "alerts", batch_id)
            mine = self.spark.read.parquet(f"{self.folder}/alerts/batch_id={batch_id}").select(*COOLING)
            old = mine if old is None else old.unionByName(mine)
        if old is not None:
            self._write(old.filter(us > upto - self.cooldown_s * SECOND), "cooling", batch_id)
        self._write(rows.filter(us > upto - self.window_s * SECOND - 1), "context", batch_id)
        self._write(self.spark.createDataFrame([(upto, late)], FRONTIER), "frontier", batch_id)  # the batch is done
        self._forget(batch_id)

    def _examine(self, batch_id: int, context: DataFrame, old: DataFrame | None, done: int) -> DataFrame:
        fresh = F.unix_micros("timestamp") > done
        found = (
            self._deviations(context.filter(fresh), batch_id)
            .unionByName(sigma_match(context.filter(fresh), self.pack))
            .unionByName(c.correlate(context, self.window_s, **self.rules).filter(fresh))
            .unionByName(e.entity_lateral(context, self.window_s, self.rules.get("hosts", 3)).filter(fresh))
        )
        if old is not None:
            found = found.unionByName(old.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        else:
            found = found.withColumn("_old", F.lit(None).cast("boolean"))
        kept = reliable(c.cooldown(reliable(found), self.cooldown_s).filter("_old IS NULL").drop("_old"))
        return c.finalise(kept, context, self.window_s)

    def _deviations(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """Deviations of the new rows, given what earlier batches noted of their actors; notes the new rows too."""
        options = dict(self.entity)
        threshold = options.pop("failure_threshold", 5)
        past, pairs = self._noted("past", batch_id), self._noted("pairs", batch_id)
        if past is not None:
            actors = fresh.select("actor").distinct()
            past = reliable(e.merge_life(past.join(actors, "actor", "left_semi")))
            pairs = reliable(pairs.join(actors, "actor", "left_semi").select("actor", "source").distinct())
        seen = reliable(e.observations(fresh, past=past, pairs=pairs, **options))
        runs = reliable(e.success_after_failures(seen, threshold, past=past))
        new_past, new_pairs = e.life_of(seen, runs)
        self._write(new_past, "past", batch_id)
        self._write(new_pairs if pairs is None else new_pairs.join(pairs, ["actor", "source"], "left_anti"), "pairs", batch_id)
        return e.deviations(fresh, threshold, seen=seen, past=past, **options)

    def _forget(self, batch_id: int) -> None:
        """Remove states that no batch will read again, and fold what was noted of actors into one table now and then.

        What this batch read stays, since it may be repeated.
        """
        before = max((i for i in self._ids("frontier") if i < batch_id), default=-1)
        for table in ("context", "cooling", "frontier"):
            for old in self._ids(table):
                if old < before:
                    self._remove(table, old)
        if (batch_id + 1) % FOLD == 0:
            for table, fold in (("past", e.merge_life), ("pairs", lambda rows: rows.select("actor", "source").distinct())):
                notes = [i for i in self._ids(table) if i < batch_id]
                if notes and batch_id - 1 not in self._ids(f"{table}_folded"):
                    self._write(fold(self._noted(table, batch_id)), f"{table}_folded", batch_id - 1)
                for old in self._ids(f"{table}_folded"):
                    if old < batch_id - 1:
                        self._remove(f"{table}_folded", old)
                for old in notes:
                    self._remove(table, old)

    # ---- storage ----

    def _write(self, df: DataFrame, table: str, batch_id: int, *by: str) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{table}/batch_id={batch_id}")

    def _read(self, table: str) -> DataFrame:
        """A whole table, for readers of results."""
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _state(self, table: str, before: int) -> DataFrame | None:
        """The newest state written by a batch before ``before`` that was completed."""
        done = [i for i in self._ids("frontier") if i < before]
        if not done or max(done) not in self._ids(table):
            return None
        return self.spark.read.parquet(f"{self.folder}/{table}/batch_id={max(done)}")

    def _noted(self, table: str, before: int) -> DataFrame | None:
        """What batches before ``before`` noted: the folded table and the few notes since."""
        folded = [i for i in self._ids(f"{table}_folded") if i < before]
        upto = max(folded, default=-1)
        paths = [f"{self.folder}/{table}_folded/batch_id={upto}"] if folded else []
        paths += [f"{self.folder}/{table}/batch_id={i}" for i in self._ids(table) if upto < i < before]
        return self.spark.read.parquet(*paths) if paths else None

    def _frontier(self, batch_id: int) -> tuple[int, int]:
        """(where earlier batches stopped, late rows so far)."""
        row = self._state("frontier", batch_id)
        row = None if row is None else row.first()
        return (START, 0) if row is None else (row["frontier"], row["late"])

    def _fs(self, below: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _ids(self, table: str) -> list[int]:
        """Batches whose folder of ``table`` is complete; tables listed here have a bounded number of them."""
        fs, path = self._fs(table)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return [int(n.split("=")[1]) for n in names if n.startswith("batch_id=") and fs.exists(self._fs(f"{table}/{n}/_SUCCESS")[1])]

    def _remove(self, table: str, batch_id: int) -> None:
        fs, path = self._fs(f"{table}/batch_id={batch_id}")
        fs.delete(path, True)
