"""Reports from kept counts, beside the reports on all events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import reports
from tracewarden.operators.rollup import Rollup
from tracewarden.session import scratch_folder

START = datetime(2024, 1, 15, 12)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Events around minute borders, with nulls, in no order of time."""
    made = []
    for i in range(400):
        at = None if i % 41 == 0 else START + timedelta(seconds=(i * 7919) % 9000, microseconds=[0, 1, 999_999][i % 3])
        made.append((f"e{i}", at, [None, "linux", "windows"][i % 3], ["h1", None, "unknown", "h2"][i % 4], [None, "ann", "bob"][i * i % 3],
                     ["auth", None][i % 2], [None, 1, 5, 9][i % 4], "x"))
    made += [("edge", START + timedelta(seconds=s), "linux", "h1", "ann", "auth", 3, "x") for s in (0, 60, 3600, 5400, 9000)]
    return spark.createDataFrame(made, "event_id string, timestamp timestamp, platform string, source string, actor string, event_type string, severity int, raw_payload string")


def kept(spark, events, pieces=5, compact_after=()):
    rollup = Rollup(spark, scratch_folder(spark))
    for i in range(pieces):
        piece = events.filter(F.pmod(F.xxhash64("event_id", "timestamp"), F.lit(pieces)) == i)  # each with rows of all times
        rollup.append(piece, i)
        rollup.append(piece, i)  # a repeated batch
        if i in compact_after:
            rollup.compact()
            rollup.append(piece, i)
    return rollup


@pytest.mark.parametrize("compact_after", [(), (1, 3), (0, 1, 2, 4)])
def test_same_reports(spark, odd, compact_after):
    rollup = kept(spark, odd, compact_after=compact_after)
    for as_of in ("2024-01-15 13:30:00", "2024-01-15 13:30:17.000001", "2024-01-15 12:00:00"):
        assert rows(rollup.dashboard(odd, as_of)) == rows(reports.dashboard(odd, as_of))
    assert rows(rollup.count_by("platform")) == rows(reports.count_by(odd, "platform"))
    assert rows(rollup.count_by("severity")) == rows(reports.count_by(odd, "severity"))


@pytest.mark.parametrize("since,until,bucket,platform", [
    ("2024-01-15 12:00:00", "2024-01-15 14:30:00", "minute", None), ("2024-01-15 12:10:30.5", "2024-01-15 13:01:01", "minute", "linux"),
    ("2024-01-15 12:10:10", "2024-01-15 12:10:50", "hour", None), (None, None, "week", None), ("2024-01-15 13:00:00", "2024-01-15 12:00:00", "day", None)])
def test_same_timeline(spark, odd, since, until, bucket, platform):
    rollup = kept(spark, odd, 2, (0,))
    args = ("2024-01-15 14:00:03", bucket, since, until, platform)
    assert rows(rollup.timeline(odd, *args)) == rows(reports.timeline(odd, *args))


def test_stream_empty_and_bounded_folders(spark, odd):
    rollup, source = Rollup(spark, scratch_folder(spark)), scratch_folder(spark)
    assert rows(rollup.dashboard(odd.limit(0), "2024-01-15")) == rows(reports.dashboard(odd.limit(0), "2024-01-15"))
    for i in range(5):
        odd.filter(F.pmod(F.xxhash64("event_id", "timestamp"), F.lit(5)) == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(odd.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rollup.follow(stream, scratch_folder(spark), compact_every=2, availableNow=True).awaitTermination()
    assert rows(rollup.dashboard(odd, "2024-01-15 13:30:17")) == rows(reports.dashboard(odd, "2024-01-15 13:30:17"))
    base, deltas = rollup._state()
    assert base == 3 and deltas == [4]
