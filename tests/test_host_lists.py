"""The first hosts of an alert by blocks of alert numbers, beside the join with every stay."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import correlate as c
from tracewarden.operators.host_lists import first_hosts, numbered_stays

START = datetime(2024, 1, 15)
SECOND = 1_000_000


def stays_of(spark, rows):
    zero = spark.range(1).select(F.unix_micros(F.lit(START))).first()[0]
    return spark.createDataFrame([(a, h, zero + s * SECOND, zero + e * SECOND) for a, h, s, e in rows],
                                 "actor string, source string, _start bigint, _end bigint")


def alerts_of(spark, rows):
    return spark.createDataFrame([(f"a{i}", a, None if s is None else START + timedelta(seconds=s)) for i, (a, s) in enumerate(rows)],
                                 "alert_id string, actor string, timestamp timestamp")


def names(df, keep):
    return {r["alert_id"]: r["hosts"] for r in c.first_names(df.withColumnRenamed("host", "name"), "hosts", keep).collect()}


@pytest.mark.parametrize("seed,keep,hot_rows", [(1, 1, 4_000_000), (2, 3, 4_000_000), (3, 5, 40), (4, 100, 4_000_000)])
def test_same_names_as_the_full_join(spark, seed, keep, hot_rows):
    rnd = random.Random(seed)
    stays = []
    for _ in range(400):
        start = rnd.randrange(0, 5_000)
        stays.append((rnd.choice(["ann", "ann", "bob"]), f"h{rnd.randrange(60):02d}", start, start + rnd.randrange(1, 900)))
    alerts = [(rnd.choice(["ann", "bob", "nobody"]), rnd.randrange(0, 6_000)) for _ in range(150)]
    alerts += [("ann", stays[0][2]), ("ann", stays[0][3]), ("ann", 777), ("ann", 777)]  # at both edges, and at one moment
    stays, alerts = stays_of(spark, stays), alerts_of(spark, alerts)
    assert names(first_hosts(alerts, stays, keep, hot_rows), keep) == names(c.alert_hosts(alerts, stays, 600), keep)


def test_rows_are_bounded_on_many_hosts(spark):
    """100,000 hosts on one actor and 64 alerts: not 6.4 million rows, but at most keep a level."""
    zero = spark.range(1).select(F.unix_micros(F.lit(START))).first()[0]
    stays = spark.range(100_000).select(
        F.lit("ann").alias("actor"), F.format_string("h%06d", F.col("id")).alias("source"),
        (F.lit(zero) + F.col("id") % 50 * SECOND).alias("_start"), F.lit(zero + 1_000 * SECOND).alias("_end"))
    alerts = alerts_of(spark, [("ann", 10 * i) for i in range(64)])
    found = first_hosts(alerts, stays, 5)
    assert found.count() <= 64 * 5 * 7
    got = names(found, 5)
    assert got["a0"] == [f"h{i:06d}" for i in range(0, 250, 50)]
    assert got["a63"] == [f"h{i:06d}" for i in range(5)]


def test_nulls_empty_and_unseen(spark):
    stays = stays_of(spark, [("ann", "x", 0, 5), ("ann", None, 0, 50), (None, "y", 0, 50), ("zoe", "z", 0, 50)])
    alerts = alerts_of(spark, [("ann", 6), (None, 3), ("ann", None)])
    at, met = numbered_stays(alerts, stays)
    assert [tuple(r) for r in met.collect()] == [("ann", None, 0, 1)]  # no alert falls into the others
    assert [r["alert_id"] for r in at.collect()] == ["a0"]
    assert first_hosts(alerts.limit(0), stays, 3).count() == 0
    assert first_hosts(alerts, stays.limit(0), 3).count() == 0
