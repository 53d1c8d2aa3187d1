"""First arrival wins, and retention of the live table: also when a run stops half-way and is repeated."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tracewarden.sources import arrivals, tables


def fresh():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"


def sample(events):
    return events.filter("CAST(event_id AS INT) % 3 = 0").cache()


def test_first_arrival_wins_over_earlier_event_time(spark, make):
    path = fresh()
    a = make([(100, "bob", "a", 4624), (200, "bob", "b", 4624)])  # e0000, e0001
    late = a.withColumns({"timestamp": F.col("timestamp") - F.expr("INTERVAL 2 DAYS"), "source": F.lit("later")})
    arrivals.append_first(a, path, 0, buckets=4)
    arrivals.append_first(late.unionByName(make([(1, "x", "c", 4624)]).withColumn("event_id", F.lit("new"))), path, 1, buckets=4)
    got = {r.event_id: r.source for r in arrivals.read_first(spark, path).collect()}
    assert got == {"e0000": "a", "e0001": "b", "new": "c"}


def test_order_inside_a_batch_and_rows_without_key(spark, make):
    path = fresh()
    rows = make([(9, "bob", "third", 4624), (1, "bob", "second", 4624), (5, "bob", "first", 4624)]).withColumns({
        "seq": F.when(F.col("source") == "first", 1).when(F.col("source") == "second", 2).otherwise(3), "event_id": F.lit("same")})
    none = rows.withColumns({"event_id": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("timestamp")})
    arrivals.append_first(rows.unionByName(none), path, 0, arrival="seq", buckets=3)
    got = arrivals.read_first(spark, path)
    assert [r.source for r in got.filter("event_id IS NOT NULL").collect()] == ["first"]
    assert got.filter("event_id IS NULL").count() == 3


def test_a_repeated_batch_changes_nothing(spark, make):
    path = fresh()
    a, b = make([(1, "bob", "a", 4624)]), make([(2, "eve", "b", 4624), (3, "eve", "c", 4624)])
    arrivals.append_first(a, path, 0, buckets=2)
    arrivals.append_first(b, path, 1, buckets=2)
    arrivals.append_first(b, path, 1, buckets=2)
    fs, marker = arrivals._fs(spark, f"{path}/commits/1")
    fs.delete(marker, False)  # as if the run had stopped before its commit
    assert arrivals.read_first(spark, path).count() == 1
    arrivals.append_first(b, path, 1, buckets=2)
    assert sorted(r.event_id for r in arrivals.read_first(spark, path).collect()) == ["e0000", "e0001"]


def test_files_of_the_key_index_stay_bounded(spark, make, monkeypatch):
    monkeypatch.setattr(arrivals, "FOLD", 2)
    path = fresh()
    for i in range(7):
        rows = make([(k, "bob", "a", 4624) for k in range(6)]).withColumn("event_id", F.concat(F.lit(f"{i}-"), "event_id"))
        arrivals.append_first(rows, path, i, buckets=2)
    assert arrivals.read_first(spark, path).count() == 42
    assert max(arrivals.key_files(spark, path).values()) <= 3
    again = make([(k, "bob", "a", 4624) for k in range(6)]).withColumn("event_id", F.concat(F.lit("0-"), "event_id"))
    monkeypatch.setattr(arrivals, "LISTED", 2)  # the join instead of the list
    arrivals.append_first(again, path, 7, buckets=2)
    assert arrivals.read_first(spark, path).count() == 42


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


@pytest.mark.parametrize("stop", [None, "marker", "delete"])
def test_retention(spark, events, monkeypatch, stop):
    live, archive = fresh(), fresh()
    rows = sample(events)
    tables.write_dated(rows, live)
    limit = "2024-01-12 12:00:00"
    old, young = ids(rows.filter(F.col("timestamp") < limit)), ids(rows.filter(F.col("timestamp") >= limit))
    if stop:
        def broken(*args):
            raise RuntimeError("stopped")

        with monkeypatch.context() as m:
            if stop == "marker":
                m.setattr(spark.catalog.__class__, "refreshByPath", broken)
            else:
                m.setattr(tables, "_limits", lambda *a, n=[0]: broken() if n.append(1) or len(n) > 2 else [])
            with pytest.raises(RuntimeError):
                tables.retain_events(spark, live, archive, "2024-04-11 12:00:00", 90)
        assert ids(tables.read_all(spark, live, archive)) == sorted(old + young)
    for _ in range(2):
        tables.retain_events(spark, live, archive, "2024-04-11 12:00:00", 90)
        assert ids(tables.read_live(spark, live)) == young and ids(spark.read.parquet(live)) == young
        assert ids(spark.read.parquet(archive)) == old
        assert ids(tables.read_all(spark, live, archive)) == sorted(old + young)
    tables.retain_events(spark, live, archive, "2024-04-21", 90)
    assert ids(spark.read.parquet(live)) == ids(rows.filter(F.col("timestamp") >= "2024-01-22"))
    assert ids(tables.read_all(spark, live, archive)) == sorted(old + young)
    tables.retain_events(spark, live, archive, "2024-04-11 12:00:00", 90)  # an older limit changes nothing
    assert ids(tables.read_all(spark, live, archive)) == sorted(old + young)


def test_retention_of_everything(spark, make):
    live, archive = fresh(), fresh()
    tables.write_dated(make([(0, "a", "h", 4624)]), live)
    for _ in range(2):
        tables.retain_events(spark, live, archive, "2025-01-01")
        assert tables.read_live(spark, live).count() == 0 and ids(tables.read_all(spark, live, archive)) == ["e0000"]


def test_retention_keeps_rows_without_time_or_id(spark, make):
    live, archive = fresh(), fresh()
    rows = make([(0, "a", "h", 4624), (1, "b", "h", 4624), (2, "c", "h", 4624)])
    rows = rows.withColumns({"timestamp": F.when(F.col("actor") != "a", F.col("timestamp")), "event_id": F.when(F.col("actor") != "b", F.col("event_id"))})
    tables.write_dated(rows, live)
    for _ in range(2):
        tables.retain_events(spark, live, archive, "2025-01-01")
        assert [r.actor for r in tables.read_live(spark, live).collect()] == ["a"]
        assert sorted(r.actor for r in tables.read_all(spark, live, archive).collect()) == ["a", "b", "c"]
