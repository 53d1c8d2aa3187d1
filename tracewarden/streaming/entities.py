"""Entity behaviour on a stream: risk after each event, the snapshot, the timeline and the deviation alerts, as events arrive.

What must be known of an actor is keyed state in the state store (``transformWithState`` on RocksDB): one row of counts, the
events of the lateral window (at most ``last``) and its first hosts; further hosts are a map that is looked up by name and never read
as a whole. A micro-batch costs what its own rows and actors cost, however much came before.

The rows of an actor are taken in order of (time, id) inside a micro-batch, and batches as they arrive. A row that is late adds to the
counts when it arrives: none is dropped, and no watermark is needed. Rows that come in order give what the batch operators give. Rows
without a time count as earliest. The rows of one bucket of actors in one micro-batch are held by one task; bound a batch by the trigger of the source.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracewarden.functions import fixed
from tracewarden.functions.text import risk_label
from tracewarden.functions.times import micros
from tracewarden.operators import entities as e
from tracewarden.operators.narrative import five_w

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = -(2**62)
# Flags of an event, by bit in the state.
FLAGS = ["new_host_access", "audit_log_cleared", "new_service", "new_account_created", "group_membership_change",
         "scheduled_task_created", "after_hours_access", "stale_account_active", "lateral_movement", "success_after_failures"]
BIT = {name: 1 << k for k, name in enumerate(FLAGS)}
OWN = FLAGS[1:6]  # raised by the kind of event alone

LIFE = ("first_us long, last_us long, events long, failures long, successes long, reset long, risk double, risk_us long, hours int, "
        "flags int, types array<string>, hosts array<string>, host_count long")
LIFE_NAMES = [c.split()[0] for c in LIFE.split(", ")]
STATE = f"{LIFE}, few array<string>, times array<long>, places array<string>"
# Host names of an actor that are kept in its state; further ones are rows of their own, which are looked up by name.
HELD_NAMES = 128
# Actors are dealt into this many buckets; fixed for the life of a stream.
BUCKETS = 4096
SEEN = ("event_id string, _us long, actor string, source string, target string, event_type string, severity int, description string, "
        "branch string")
OUT = f"{SEEN}, flags array<string>, run long, on_host boolean, risk_added double, risk_score double, life struct<{LIFE.replace(' ', ':').replace(',:', ',')}>"


class ActorLife(StatefulProcessor):
    """Adds to each event of an actor what it means for the actor; the last one of a micro-batch carries the actor's life so far.

    Actors are dealt into buckets, and a call takes the rows of a bucket: one read and one write of the state per actor, and one table
    out per bucket.
    """

    def __init__(self, window_s: int, hosts: int, last: int, failure_threshold: int, shown_hosts: int,
                 night_start: int = 22, night_end: int = 5, history: int = 10, stale_days: int = 90):
        self.window, self.hosts, self.last, self.threshold, self.shown = window_s * e.SECOND, hosts, last, failure_threshold, shown_hosts
        self.night_start, self.night_end, self.history, self.stale = night_start, night_end, history, stale_days * e.DAY

    def init(self, handle) -> None:
        # A null name has a key of its own.
        self.lives = handle.getMapState("lives", "named boolean, actor string", STATE)
        self.known = handle.getMapState("known", "named boolean, actor string, on_source boolean, source string", "us long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        rows = rows.sort_values(["actor", "at_us", "event_id"], kind="stable", ignore_index=True)
        names = rows["actor"].astype(object).where(rows["actor"].notna(), None).to_numpy(object)
        turn = np.r_[True, names[1:] != names[:-1]]
        starts = np.flatnonzero(turn).tolist()
        source = rows["source"].astype(object).where(rows["source"].notna(), None).tolist()
        us, hour = rows["at_us"].tolist(), rows["at_hour"].tolist()
        branch, auth, kind = rows["branch"].tolist(), rows["is_auth"].tolist(), rows["event_type"].tolist()
        out = [], [], [], [], [], []
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            actor = names[a]
            named = (actor is not None, actor or "")
            old = self.lives.getValue(named)
            life, recent = self._lived(actor, named, old, us[a:b], hour[a:b], branch[a:b], auth[a:b], kind[a:b], source[a:b], out)
            self.lives.updateValue(named, (*life, *recent))
            out[5].extend([None] * (b - a - 1))
            out[5].append(dict(zip(LIFE_NAMES, life)))
        table = rows.drop(columns=["bucket", "is_auth", "at_hour"]).rename(columns={"at_us": "_us"})
        table["flags"], table["run"], table["on_host"], table["risk_added"] = out[0], pd.array(out[1], "Int64"), out[2], out[3]
        table["risk_score"] = np.round(np.minimum(out[4], fixed.RISK_CEILING), 2)
        table["life"] = out[5]
        yield table

    def _lived(self, actor, named, old, us, hour, branch, auth, kind, source, out):
        """The life of an actor after the given rows; what each row means goes to the lists of ``out``."""
        (first, last, events, failures, successes, reset, risk, risk_us, hours, seen, types, hosts, host_count, few, times, places) = (
            tuple(old) if old is not None else (None, NO_TIME, 0, 0, 0, 0, 0.0, None, 0, 0, [], [], 0, [], [], []))
        types, few, new_names = set(types), set(few), []
        held = deque(zip(times, places))
        count = Counter(places)
        all_flags, runs, on_hosts, added, scores, _ = out
        for at, h, b, is_auth, k, host in zip(us, hour, branch, auth, kind, source):
            on_host = self._first_time(named, host, few)
            if on_host and host is not None and host != "unknown":
                new_names.append(host)
            events += 1
            failures += b == "auth_failure"
            successes += b == "auth_success"
            flags = []
            if on_host and b == "auth_success" and host != "unknown":
                flags.append("new_host_access")
            if b in OWN:
                flags.append(b)
            if is_auth and events > self.history and (h >= self.night_start or h <= self.night_end):
                flags.append("after_hours_access")
            if is_auth and last > NO_TIME and at > NO_TIME and at - last >= self.stale:
                flags.append("stale_account_active")
            if actor != "unknown":
                held.append((at, host))
                count[host] += 1
                while len(held) > self.last or held[0][0] < at - self.window:
                    gone = held.popleft()[1]
                    count[gone] -= 1
                    if not count[gone]:
                        del count[gone]
                if len(count) >= self.hosts:
                    flags.append("lateral_movement")
            rise = fixed.RISK["auth_failure"] if b == "auth_failure" else fixed.RISK["high_severity"] if b == "high_severity" else 0.0
            for name in flags:
                rise += fixed.RISK[name]
                seen |= BIT[name]
            risk += rise
            run = None
            if b == "auth_success" and failures - reset >= self.threshold:
                # A success ends the run of failures only if it is long enough.
                run, reset = failures - reset, failures
                seen |= BIT["success_after_failures"]
            last = max(last, at)
            if at > NO_TIME:
                first = at if first is None else min(first, at)
                if rise > 0:
                    risk_us = at if risk_us is None else max(at, risk_us)
            if h >= 0:
                hours |= 1 << h
            if k is not None and k == k:
                types.add(k)
            all_flags.append(flags)
            runs.append(run)
            on_hosts.append(on_host and host != "unknown")
            added.append(rise)
            scores.append(risk)
        if new_names:
            hosts = sorted([*hosts, *new_names])[: self.shown]
            host_count += len(new_names)
        life = (first, last, events, failures, successes, reset, risk, risk_us, hours, seen, sorted(types), list(hosts), host_count)
        return life, (sorted(few), [t for t, _ in held], [s for _, s in held])

    def _first_time(self, named, host, few: set) -> bool:
        """Whether the actor was not on ``host`` before. The first names are part of its state, the rest is looked up by name."""
        name = "" if host is None else f"+{host}"
        if name in few:
            return False
        if len(few) < HELD_NAMES:
            few.add(name)
            return True
        place = (*named, host is not None, host or "")
        if self.known.containsKey(place):
            return False
        self.known.updateValue(place, (0,))
        return True


def live_observations(
    events: DataFrame, window_s: int = 600, hosts: int = 3, last: int = 100, failure_threshold: int = 5, shown_hosts: int = 20, **hours
) -> DataFrame:
    """A stream of events -> the tracked ones with flags, ``run``, risk, and per actor and micro-batch its ``life``."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = e.tracked(events).select(
        "event_id", F.coalesce(micros(F.col("timestamp")), F.lit(NO_TIME)).alias("at_us"), "actor", "source", "target", "event_type", "severity",
        "description", e._branch().alias("branch"), F.coalesce(F.col("event_type") == "auth", F.lit(False)).alias("is_auth"),
        F.coalesce(F.hour("timestamp"), F.lit(-1)).alias("at_hour"), F.pmod(F.xxhash64("actor"), F.lit(BUCKETS)).alias("bucket"))
    processor = ActorLife(window_s, hosts, last, failure_threshold, shown_hosts, **hours)
    seen = rows.groupBy("bucket").transformWithStateInPandas(processor, OUT, "Append", "None")
    return seen.withColumn("timestamp", F.when(F.col("_us") > NO_TIME, F.timestamp_micros("_us")))


class LiveEntities:
    """Keeps risk, timeline, deviation alerts and the entity snapshot of a stream of events in ``folder``.

    Each micro-batch appends what it changed, in folders named by its id, so a retry overwrites. Every ``compact_every`` batches the
    changes of the snapshot are folded into a new base, which replaces the changes that it holds.
    """

    def __init__(
        self, spark: SparkSession, folder: str, window_s: int = 600, hosts: int = 3, failure_threshold: int = 5, min_severity: int = 4,
        compact_every: int = 50, shown_hosts: int = 20, **hours,
    ):
        self.spark, self.folder, self.compact_every, self.min_severity = spark, folder.rstrip("/"), compact_every, min_severity
        self.options = {"window_s": window_s, "hosts": hosts, "failure_threshold": failure_threshold, "shown_hosts": shown_hosts, **hours}

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        writer = live_observations(events, **self.options).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()

    def process(self, seen: DataFrame, batch_id: int) -> None:
        seen = seen.persist()  # recomputed from the state of the batch if an executor is lost
        try:
            self._write(seen.select("actor", "event_id", "timestamp", "risk_added", "risk_score", risk_label(F.col("risk_score")).alias("risk_label")),
                        "risk", batch_id)
            own = F.array_remove("flags", "lateral_movement")
            loud = (F.col("severity") >= self.min_severity) | (F.size(own) > 0) | F.col("run").isNotNull()
            timeline = seen.filter(loud).select(
                F.col("actor").alias("entity_id"), "timestamp", "event_id", "event_type", "target", F.col("source").alias("source_host"),
                "severity", "description")
            self._write(timeline, "timeline", batch_id)
            hours = {k: v for k, v in self.options.items() if k == "stale_days"}
            self._write(e.deviation_alerts(seen, seen.filter("run IS NOT NULL"), **hours), "deviations", batch_id)
            self._write(seen.filter("life IS NOT NULL").select("actor", "life.*"), "lives", batch_id)
            self._write(seen.filter("on_host").groupBy("source").agg(F.min("timestamp").alias("first_seen")), "sources", batch_id)
        finally:
            seen.unpersist()
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    # ---- What readers see ----

    def risk(self) -> DataFrame:
        return self._read("risk").drop("batch_id")

    def timeline(self) -> DataFrame:
        return self._read("timeline").drop("batch_id")

    def deviations(self) -> DataFrame:
        return self._read("deviations").drop("batch_id")

    def narrated(self, as_of) -> DataFrame:
        """The deviation alerts with their narratives."""
        return five_w(self.deviations().withColumn("distinct_hosts", F.lit(None).cast("array<string>")), as_of)

    def snapshot(self) -> DataFrame:
        actors = self._lives().withColumns({
            "first_seen": F.timestamp_micros("first_us"), "last_seen": F.when(F.col("last_us") > NO_TIME, F.timestamp_micros("last_us")),
            "risk_at": F.timestamp_micros("risk_us"),
            "hours": F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.call_function("getbit", F.col("hours"), h) == 1),
            "flags": F.array_compact(F.array(*[F.when(F.col("flags").bitwiseAND(1 << k) > 0, F.lit(n)) for k, n in enumerate(FLAGS)])),
        })
        return e.snapshot_rows(actors, self._sources())

    def compact(self, batch_id: int) -> None:
        """Fold the changes up to ``batch_id`` into a new base and remove what it replaces."""
        for table, rows in (("lives", self._lives()), ("sources", self._sources())):
            if batch_id not in self._ids(f"{table}_base", "upto"):  # else the batch is repeated
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{table}_base/upto={batch_id}")
            for old in self._ids(f"{table}_base", "upto"):
                if old < batch_id:
                    self._remove(f"{table}_base/upto={old}")
            for old in self._ids(table, "batch_id"):
                if old <= batch_id:
                    self._remove(f"{table}/batch_id={old}")

    # ---- Storage ----

    def _lives(self) -> DataFrame:
        """The newest life of each actor: the later the batch, the more it has seen."""
        rows = self._changes("lives")
        rest = [c for c in rows.columns if c not in ("actor", "batch_id")]
        return rows.groupBy("actor").agg(F.max_by(F.struct(*rest), "batch_id").alias("x")).select("actor", "x.*")

    def _sources(self) -> DataFrame:
        return self._changes("sources").groupBy("source").agg(F.min("first_seen").alias("first_seen"))

    def _changes(self, table: str) -> DataFrame:
        bases = self._ids(f"{table}_base", "upto")
        upto = max(bases, default=-1)
        parts = [self.spark.read.parquet(f"{self.folder}/{table}_base/upto={upto}").withColumn("batch_id", F.lit(upto))] if bases else []
        later = [i for i in self._ids(table, "batch_id") if i > upto]
        if later:
            paths = [f"{self.folder}/{table}/batch_id={i}" for i in later]
            parts.append(self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths))
        rows = parts[0]
        return rows.unionByName(parts[1]) if len(parts) > 1 else rows

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{table}/batch_id={batch_id}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _fs(self, below: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _ids(self, table: str, name: str) -> list[int]:
        """Ids of the complete folders of a table."""
        fs, path = self._fs(table)
        if not fs.exists(path):
            return []
        done = [f.getPath().getName() for f in fs.listStatus(path) if fs.exists(self._fs(f"{table}/{f.getPath().getName()}/_SUCCESS")[1])]
        return sorted(int(d.split("=")[1]) for d in done if d.startswith(f"{name}="))

    def _remove(self, below: str) -> None:
        fs, path = self._fs(below)
        fs.delete(path, True)
