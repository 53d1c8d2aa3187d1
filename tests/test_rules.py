"""Hand-made sequences around thresholds, windows and hours."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import correlate as c
from tracewarden.operators import entities as e
from tracewarden.plans import detection


def test_brute_force_threshold_and_window(make):
    fail = [(i * 60, "bob", "h1", 4625) for i in range(10)]
    assert c.brute_force(make(fail[:9])).count() == 0
    assert c.brute_force(make(fail)).count() == 1
    at_edge = [(0, "bob", "h1", 4625)] + [(600, "bob", "h1", 4625)] * 9
    assert c.brute_force(make(at_edge)).count() == 9  # peers see each other, and the failure 600 s ago counts
    assert c.brute_force(make([(0, "bob", "h1", 4625)] + [(601, "bob", "h1", 4625)] * 9)).count() == 0


def test_lateral_ignores_unknown(make):
    hosts = lambda *names: make([(i, "bob", h, 4624) for i, h in enumerate(names)])
    assert c.lateral_movement(hosts("a", "b", "unknown")).count() == 0
    assert c.lateral_movement(hosts("a", "b", "c")).count() == 1


def test_persistence_needs_the_same_host(make):
    assert c.persistence_after_auth(make([(0, "bob", "a", 4624), (5, "sys", "a", 7045)])).count() == 1
    assert c.persistence_after_auth(make([(0, "bob", "a", 4624), (5, "sys", "b", 7045)])).count() == 0


@pytest.mark.parametrize("hour,minute,fires", [(6, 59, 1), (7, 0, 0), (17, 59, 0), (18, 0, 1)])
def test_after_hours(make, hour, minute, fires):
    rows = make([(-2, "bob", "a", 4720), (-1, "bob", "a", 4720), (0, "bob", "a", 4624)], datetime(2024, 1, 15, hour, minute, 1))
    rows = rows.filter((F.col("raw_event_id") != 4624) | (F.minute("timestamp") == minute))
    assert c.after_hours_auth(rows).filter("event_id = 'e0002'").count() == fires


def test_new_source(make):
    rows = [(i, "bob", "a", 4624) for i in range(4)] + [(10, "bob", "b", 4624), (20, "bob", "b", 4624)]
    got = c.new_source_auth(make(rows)).collect()
    assert [r["event_id"] for r in got] == ["e0004"]


def test_success_below_threshold_does_not_reset(make):
    rows = [(i, "bob", "a", 4625) for i in range(4)] + [(5, "bob", "a", 4624), (6, "bob", "a", 4625), (7, "bob", "a", 4624)]
    seen = e.observations(make(rows))
    got = e.success_after_failures(seen).collect()
    assert [(r["event_id"], r["run"]) for r in got] == [("e0006", 5)]


def test_noise_and_risk_ceiling(make):
    rows = [(i, "eve", "a", 1102, 10) for i in range(5)] + [(9, "unknown", "b", 4625, 2)]
    snap = {r["entity_id"]: r for r in e.entity_snapshot(make(rows)).collect()}
    assert snap["eve"]["risk_score"] == 100.0 and snap["eve"]["risk_label"] == "CRITICAL"
    assert "unknown" not in snap and snap["a"]["event_count"] == 0


def test_stale_gap(make):
    day = 86_400
    rows = make([(0, "bob", "a", 4624), (91 * day, "bob", "a", 4624), (92 * day, "bob", "a", 4624)])
    got = e.deviations(rows).filter("alert_type = 'stale_account_active'").collect()
    assert [r["event_id"] for r in got] == ["e0001"]


def test_decay_and_stale_marking(make):
    snap = e.entity_snapshot(make([(0, "bob", "a", 4720)]))
    lowered = e.decay(snap, "2024-01-15 17:00:00").filter("entity_id = 'bob'").first()
    assert lowered["risk_score"] == 20.0  # idle less than a day
    lowered = e.decay(snap, "2024-01-16 12:00:00").filter("entity_id = 'bob'").first()
    assert lowered["risk_score"] == 0.0 and lowered["risk_label"] == "CLEAN"
    assert e.mark_stale(snap, "2024-06-01").filter("is_stale").count() == 2


def test_evidence_and_texts(make):
    rows = [(i * 10, "bob@10.0.0.9", "h1", 4625) for i in range(12)] + [(130, "bob@10.0.0.9", "h1", 4624)]
    told = detection.investigate(make(rows), "2024-01-16 00:00:00").collect()
    by_type = {r["alert_type"]: r for r in told}
    brute = by_type["brute_force"]
    assert brute["event_ids"] == [f"e{i:04d}" for i in range(10)] and brute["metadata"]["span_seconds"] == "90"
    assert brute["five_w"]["when"]["attack_span"] == "1m 30s" and brute["five_w"]["who"]["source_ip"] == "10.0.0.9"
    assert by_type["credential_stuffing"]["event_ids"] == [f"e{i:04d}" for i in (7, 8, 9, 10, 11, 12)]
    assert any("10.0.0.9" in line for line in brute["five_w"]["how"]["general_commands"])
    assert len(told) == len({(r["alert_type"], r["actor"], r["source_host"]) for r in told})


def test_first_stage_wins_the_cooldown(make):
    got = detection.detect(make([(0, "bob", "a", 1102)])).filter("alert_type = 'audit_log_cleared'").collect()
    assert [r["stage"] for r in got] == [0]


def test_custom_rule(make):
    rows = make([(0, "bob", "a", 4740)])
    c.register("locked", lambda ev: c.emit(c.traced(ev), (F.lit(True), c.alert_struct(
        "entity", "LOW", F.lit("x"), F.lit("y"), "", "", c.metadata(), c.proof("own", 0, True), alert_type="locked"))))
    try:
        assert c.correlate(rows).filter("alert_type = 'locked'").count() == 1
    finally:
        c.unregister("locked")


def test_input_order_does_not_matter(events):
    shuffled = events.orderBy(F.rand(3))
    pick = ["alert_type", "actor", "event_id", "title"]
    got = [sorted(map(tuple, c.correlate(x, 86_400, 3, 2, 2).select(*pick).collect())) for x in (events, shuffled)]
    assert got[0] == got[1]


def test_alerts_of_events_without_ids(make):
    """Two attacks an hour apart keep their own ids, evidence and span."""
    rows = make([(i, "bob", "h1", 4625) for i in range(10)] + [(3600 + i, "bob", "h1", 4625) for i in range(10)])
    brute = detection.detect(rows.withColumn("event_id", F.lit(None).cast("string"))).filter("alert_type = 'brute_force'").collect()
    assert len({r["alert_id"] for r in brute}) == 2
    assert all(len(r["event_ids"]) == 10 and r["metadata"]["span_seconds"] == "9" for r in brute)
    assert not set(brute[0]["event_ids"]) & set(brute[1]["event_ids"])


def test_events_without_ids_times_and_actors(make):
    """Missing values cost nothing but what needs them: alerts of whole events stay, nothing crashes, copies keep apart."""
    whole = make([(i, "bob", "h1", 4625) for i in range(12)] + [(50, "eve", "h2", 1102)])
    broken = make([(i, "carl", f"h{i % 5}", 4624) for i in range(30)]).withColumns({
        "event_id": F.when(F.col("raw_event_id") < 0, F.col("event_id")),
        "timestamp": F.when(F.expr("source != 'h1'"), F.col("timestamp")),
        "actor": F.when(F.expr("source != 'h2'"), F.col("actor"))})
    pick = lambda df: {(r["alert_type"], r["actor"], r["source_host"], r["event_id"]) for r in df.collect()}
    got, want = pick(detection.detect(whole.unionByName(broken))), pick(detection.detect(whole))
    assert want <= got and all(a[1] in ("carl", None) for a in got - want)
    assert detection.detect(broken).filter("alert_id IS NULL OR event_id IS NULL").count() == 0


def test_pruned_names_are_those_of_the_greedy_rule(make):
    import bisect
    import random

    draw = random.Random(8)
    rows = [("a", f"n{draw.randrange(10**6)}", 0, draw.randrange(50)) for _ in range(400)]
    spark = make([(0, "a", "b", 1)]).sparkSession
    cut = spark.createDataFrame([(*r, 0) for r in rows], "actor string, source string, _slice bigint, _at bigint, _piece bigint")
    for sign in (1, -1):
        for keep in (0, 1, 10):
            names, want = [], []
            for _, name, _, at in sorted(rows, key=lambda r: (sign * r[3], r[1])):
                if len(names) <= keep or name < names[keep]:
                    bisect.insort(names, name)
                    del names[keep + 1 :]
                    want.append((name, at))
            assert sorted((r["source"], r["_at"]) for r in c._candidates(cut, sign, keep).collect()) == sorted(want)


def test_hot_keys_counted_once(make):
    """Keys that one count finds hot are cut in every operator; alerts stay the same."""
    rows = make([(7 * i, ("bob", "eve", None)[i % 3], f"h{i % 4}", (4625, 4624, 1102, 4732)[i % 4]) for i in range(120)])
    events, hot = detection.prepared(rows, 80)
    assert {k: v and v[1] for k, v in hot.known.items()} == {
        frozenset(["actor"]): 3, frozenset(["source"]): 4, frozenset(["actor", "source"]): None}
    pick = ["alert_type", "actor", "source_host", "event_id", "event_ids"]
    got = [sorted(map(str, detection.detect(rows, hot_rows=h, hosts=2).select(*pick).collect())) for h in (80, 4_000_000)]
    assert got[0] == got[1] and got[0]
