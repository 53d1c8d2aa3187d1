"""Batch and stream give the same results."""

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewarden.operators.normalize import normalise_linux, parse_linux_lines
from tracewarden.operators.validate import parse_event_json, to_json_lines
from tracewarden.operators import entities as e
from tracewarden.plans import detection
from tracewarden.schema import EVENT
from tracewarden.sources import files
from tracewarden.streaming.entities import LiveEntities
from tracewarden.streaming.live import LiveDetection, dedup_stream, subscribe, timeline_stream


def fresh():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def stored(events, parts=3):
    """Events as Parquet files in order of time, one file per part."""
    folder = fresh() + "/in"
    days = {0: ("2024-01-01", "2024-01-09"), 1: ("2024-01-09", "2024-01-18"), 2: ("2024-01-18", "2024-03-01")}
    for i in range(parts):
        lo, hi = days[i]
        events.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)).coalesce(1).write.parquet(f"{folder}/part={i}")
    return folder


def follow(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(df, mode="append"):
    name = "t" + fresh().split("-")[-1].replace("_", "x")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", fresh()).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def key_rows(df):
    return sorted(map(tuple, df.select("alert_type", "actor", "source_host", "event_id", F.array_join("event_ids", ",")).collect()))


def test_live_detection_equals_batch(spark, events):
    options = {"window_s": 86_400, "cooldown_s": 7_200, "hosts": 2, "brute_force_threshold": 3, "stuffing_threshold": 2,
               "entity": {"failure_threshold": 2, "stale_days": 7}}
    live = LiveDetection(spark, fresh() + "/out", lateness_s=3_600, **options)
    live.start(follow(spark, stored(events)), fresh(), availableNow=True).awaitTermination()
    live.flush(1_000)
    assert key_rows(live.alerts()) == key_rows(detection.detect(events, **options))
    assert live.late_rows().first()["late"] == 0


def test_late_rows_are_counted_and_a_retry_changes_nothing(spark, make):
    live = LiveDetection(spark, fresh() + "/out")
    first = make([(i, "bob", "a", 4625) for i in range(10)])
    late = make([(5, "bob", "a", 4625), (100, "bob", "a", 1102)]).withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    live.process(first, 0)
    for _ in range(2):
        live.process(late, 1)
    assert live.late_rows().first()["late"] == 1
    assert sorted(r["alert_type"] for r in live.alerts().select("alert_type").collect()).count("brute_force") == 1


def test_state_of_live_detection_stays_small(spark, events, monkeypatch):
    """Some batches: what a batch reads does not grow with their number, late rows are stored, alerts have narratives."""
    from tracewarden.streaming import live as module

    monkeypatch.setattr(module, "FOLD", 2)
    options = {"window_s": 86_400, "cooldown_s": 7_200, "hosts": 2, "brute_force_threshold": 3, "stuffing_threshold": 2,
               "entity": {"failure_threshold": 2, "stale_days": 7}}
    few = events.filter("actor IN ('user-1', 'user-2', '10.0.0.5')")
    live, rows = LiveDetection(spark, fresh() + "/out", **options), few.orderBy("timestamp", "event_id").collect()
    step = -(-len(rows) // 4)
    for i in range(4):
        live.process(spark.createDataFrame(rows[i * step : (i + 1) * step], events.schema), i)
        assert max(len(live._ids(t)) for t in ("context", "frontier", "cooling")) <= 2 and len(live._ids("past")) <= 2
    again = spark.createDataFrame(rows[:2], events.schema)
    none = again.withColumn("timestamp", F.lit(None).cast("timestamp"))
    live.process(again.unionByName(none), 4)
    live.flush(5)
    assert key_rows(live.alerts()) == key_rows(detection.detect(few, **options))
    assert live.late_rows().first()["late"] == 2 and live.events().count() == len(rows) + 4
    told = live.narrated("2024-02-01")
    assert told.count() == live.alerts().count() and told.filter("five_w.how.command_count IS NULL").count() == 0


def test_json_dedup_stream(spark, events):
    folder = fresh() + "/json"
    to_json_lines(events.unionByName(events)).coalesce(1).write.text(folder)
    valid, bad = parse_event_json(files.read_json_text(spark, folder, stream=True), "2024-02-01")
    assert drain(dedup_stream(valid, "40 days")).count() == events.count()
    assert drain(bad).count() == 0


def test_timeline_and_subscription(spark, events):
    folder = stored(events)
    got = drain(timeline_stream(follow(spark, folder), "1 day", "1 hour"))
    want = events.groupBy(F.date_trunc("day", "timestamp").alias("bucket"), "platform").agg(
        F.count("*").alias("count"), F.max("severity").alias("max_severity"))
    last = got.agg(F.max("bucket")).first()[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.filter(F.col("bucket") <= last).collect()))
    assert drain(subscribe(follow(spark, folder), "linux", 5)).count() == events.filter("platform = 'linux' AND severity >= 5").count()


def test_log_lines_with_host_from_folder(spark):
    folder = fresh()
    lines = ["Jan 15 02:33:47 x sshd[1]: Failed password for root from 10.0.0.5 port 2 ssh2", "", "-- Journal begins --"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/web07")
    batch = files.read_log_lines(spark, f"{folder}/web07")
    assert batch.select("hostname").distinct().first()[0] == "web07" and batch.count() == 1
    live = drain(normalise_linux(parse_linux_lines(files.read_log_lines(spark, f"{folder}/*", stream=True), 2024, "2024-02-01")))
    row = live.first()
    assert (row["actor"], row["target"], row["source"], row["mitre_technique"]) == ("root", "10.0.0.5", "web07", "T1110")


def test_live_entities_equal_batch(spark, events):
    """Many micro-batches: risk, timeline, deviations and snapshot are those of one batch, and the state is compacted on the way."""
    folder = fresh() + "/in"
    batches = 5
    cut = F.ntile(batches).over(Window.orderBy("timestamp", "event_id"))
    pieces = events.withColumn("part", cut).persist()
    for i in range(batches):
        pieces.filter(F.col("part") == i + 1).drop("part").coalesce(1).write.parquet(f"{folder}/part={i}")
    options = {"window_s": 86_400, "hosts": 2, "failure_threshold": 2, "stale_days": 7}
    live = LiveEntities(spark, fresh() + "/out", min_severity=6, compact_every=2, **options)
    live.start(follow(spark, folder), fresh(), availableNow=True).awaitTermination()

    def same(got, want):
        columns = sorted(want.columns)
        rows = [sorted(map(str, x.select(*columns).collect())) for x in (got, want)]
        assert rows[0] == rows[1]

    same(live.snapshot(), e.entity_snapshot(events, 86_400, 2, 2, stale_days=7))
    same(live.risk(), e.risk_scores(events, window_s=86_400, hosts=2, stale_days=7))
    same(live.timeline(), e.entity_timeline(events, 6, 2, stale_days=7))
    pick = ["alert_type", "actor", "source_host", "timestamp", "event_id", "description", "severity_score"]
    same(live.deviations().select(*pick), e.deviations(events, 2, stale_days=7).select(*pick))
    told = live.narrated("2024-02-01")
    assert told.filter("five_w.what IS NULL OR five_w.who.summary IS NULL").count() == 0 and told.count() == live.deviations().count()
    assert live._ids("lives", "batch_id") == [4] and live._ids("lives_base", "upto") == [3]


class _Map(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self


def test_a_bucket_of_actors_costs_two_state_calls_an_actor():
    import pandas as pd

    from tracewarden.streaming import entities as live

    states = {}

    class Handle:
        def getMapState(self, name, key, value):
            return states.setdefault(name, _Map())

    life = live.ActorLife(600, 3, 100, 5, 20)
    life.init(Handle())

    def batch(rows):
        return pd.DataFrame([dict(event_id=f"e{at:04d}", at_us=at * 1_000_000, actor=a, source=s, target=s, event_type="auth", severity=2,
                                  description="", branch="auth_success", is_auth=True, at_hour=12, bucket=1) for at, a, s in rows])

    many = live.HELD_NAMES + 30
    few = batch([(t, a, f"h{t % 4}") for t in range(40) for a in ("ann", "bob", None)])
    out = next(life.handleInputRows((1,), iter([few]), None))
    assert states["lives"].calls == 6 and not states["known"].calls
    assert out["on_host"].sum() == 12 and out["life"].notna().sum() == 3
    out = next(life.handleInputRows((1,), iter([batch([(100 + t, "ann", f"h{t}") for t in range(many)])]), None))
    assert out["on_host"].sum() == many - 4 and out["life"].iloc[-1]["host_count"] == many
    out = next(life.handleInputRows((1,), iter([batch([(900 + t, "ann", f"h{t}") for t in range(many)])]), None))
    assert not out["on_host"].any() and out["life"].iloc[-1]["events"] == 40 + 2 * many
