"""What a row costs must not grow: the plans of steps that every alert passes."""

from pyspark.sql import functions as F

from tracewarden import session
from tracewarden.operators import correlate as c
from tracewarden.operators import entities as e
from tracewarden.operators.narrative import five_w, five_w_fields
from tracewarden.operators.search import search_entities
from tracewarden.operators.sliding import recent_presence
from tracewarden.session import written


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_emit_explodes_numbers_of_rules(make):
    rows = make([(0, "bob", "a", 1102), (1, "bob", "a", 4625), (2, "ann", "b", 4625)])
    found = c.emit(c.traced(rows), (F.col("cleared"), made("x")), (F.col("fail"), made("y")), (F.col("actor") == "bob", made("z")))
    generators = [line for line in plan_of(found).splitlines() if "Generate explode" in line]
    assert generators and not any("struct" in line or "lambda" in line for line in generators)
    got = sorted((r["title"], r["event_id"]) for r in found.collect())
    assert got == [("x", "e0000"), ("y", "e0001"), ("y", "e0002"), ("z", "e0000"), ("z", "e0001")]


def made(title):
    return c.alert_struct("entity", "LOW", F.lit(title), F.lit("y"), "", "", c.metadata(n=F.col("_us")), c.proof("own", 0, True))


def odd_alerts(spark):
    values = ["bob", "a@1.2.3.4", "{target}", "x\u0001y", "10.0.0.1"]
    rows = [(i, t, a, values[i % 5], "h\u0001" if i % 7 == 0 else None, {"failure_count": "{actor}", "k": a}, "d", "T1.2", "x", None)
            for i, (t, a) in enumerate((t, a) for t in ("brute_force", "lateral_movement", "sigma:x") for a in values)]
    return spark.createDataFrame(rows, "alert_id long, alert_type string, actor string, source_host string, target string, "
                                 "metadata map<string,string>, description string, mitre_technique string, mitre_tactic string, "
                                 "sigma_rule_id string").withColumn("timestamp", F.lit("2024-01-03 04:05:06").cast("timestamp"))


FIELDS = {"who": "who.summary", "what": "what", "reason": "why.explanation", "steps": "how.remediation_steps", "place": "where.summary"}


def test_named_fields_are_those_of_the_narrative(spark):
    alerts = odd_alerts(spark)
    whole = five_w(alerts, "2024-01-31").select("alert_id", *[F.col(f"five_w.{path}").alias(n) for n, path in FIELDS.items()])
    picked = five_w_fields(alerts, "2024-01-31", FIELDS).select("alert_id", *FIELDS)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, picked.collect()))
    marked = {r["alert_id"]: r for r in picked.collect()}
    assert "x\u0001y" in marked[3]["what"] and marked[3]["steps"][0].startswith("1. ") and len(marked[3]["steps"]) == 3


def test_texts_are_filled_only_when_asked_for(spark):
    alerts = odd_alerts(spark)
    assert "{source_ip}" not in plan_of(five_w_fields(alerts, "2024-01-31", {"who": "who.summary", "url": "why.mitre_url"}))
    assert "{source_ip}" in plan_of(five_w_fields(alerts, "2024-01-31", {"what": "what"}))


def test_copies_of_most_events_meet_in_one_shuffle(make):
    rows = make([(0, "bob", "a", 4625), (1, "ann", "b", 4624), (2, "eve", "c", 4624)])
    late = rows.filter("actor = 'bob'").withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    bare = rows.filter("actor = 'eve'").withColumn("event_id", F.lit(None).cast("string"))
    once = c.unique_events(late.unionByName(rows).unionByName(rows).unionByName(bare).unionByName(bare))
    assert "Join" not in plan_of(once)
    want = [*map(tuple, rows.collect()), *[tuple(bare.first())] * 2]
    assert sorted(map(tuple, once.select(*rows.columns).collect()), key=str) == sorted(want, key=str)
    few = c.unique_events(rows.unionByName(late.limit(1)).unionByName(bare))  # two rows of five are repeated
    assert few.count() == 4 and few.filter("event_id IS NULL").count() == 1


def test_lateral_risk_needs_one_shuffle_and_no_join(make):
    rows = make([(i, f"user{i % 2}", f"h{i % 3}", 4624) for i in range(20)])
    plan = e.risk_added(rows, 600, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_search_of_entities_reads_only_what_was_summed(make):
    rows = make([(i, f"user{i % 2}", f"h{i % 3}", 4624) for i in range(20)])
    plan = plan_of(search_entities(e.entity_snapshot(rows, 600, 2), 5, search="user"))
    assert "LogicalRDD" not in plan and "description" not in plan and "collect_set(flags" not in plan


def test_payload_of_a_test_event_is_parsed_once(events):
    assert plan_of(events.select("actor", "source", "platform", "severity")).count("get_json_object") == 1
    # A filter is pushed below the parsed number: once for the actor, and three ways to a number of an event.
    assert plan_of(e.tracked(events).select("actor")).count("get_json_object") <= 5


def test_events_of_the_windows_are_parsed_once(events, monkeypatch):
    plans = []
    monkeypatch.setattr(e, "written", lambda df: plans.append(plan_of(df)) or written(df))
    e.risk_added(events, 600, 2)
    assert [plan.count("get_json_object") for plan in plans] == [1]


def test_what_one_task_wrote_is_read_by_many(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 10, raising=False)
    back = written(spark.range(0, 35, 1, 1))
    assert len(back.inputFiles()) == 4 and sorted(r["id"] for r in back.collect()) == list(range(35))


def test_noise_of_unknown_actors_adds_no_risk(make):
    rows = make([(0, "unknown", "a", 1102, 2), (1, "unknown", "a", 1102, 3), (2, "bob", "a", 1102, 2), (3, "eve", "b", 1102, 2)])
    rows = rows.unionByName(rows.limit(1).withColumns({"event_id": F.lit("n1"), "severity": F.lit(None).cast("int")}))
    rows = rows.withColumn("actor", F.when(F.col("actor") != "eve", F.col("actor")))
    kept = sorted(r["event_id"] for r in e.tracked(rows).collect())
    assert kept == ["e0001", "e0002"]
    assert sorted(r["event_id"] for r in e.risk_added(rows, 600, 2).collect()) == kept


def test_snapshot_of_odd_rows_is_the_same_in_pieces(make):
    rows = make([(i * 40, ("bob", "ann", "unknown", "svc_x")[i % 4], ("a", "b", "c", "unknown", "d")[i * i % 5],
                  (4624, 4625, 4625, 1102, 4720)[i % 5], 2 + i % 7) for i in range(150)])
    i = F.regexp_extract("event_id", "[0-9]+", 0).cast("int")
    rows = rows.withColumns({
        "timestamp": F.when(i % 17 != 0, F.col("timestamp")), "source": F.when(i % 13 != 0, F.col("source")),
        "actor": F.when(i % 19 != 0, F.col("actor")), "event_id": F.when(i % 23 != 0, F.col("event_id")),
        "event_type": F.when(i % 29 != 0, F.col("event_type")),
    })
    plain, split = (sorted((str(r) for r in e.entity_snapshot(rows, 600, 2, 2, shown_hosts=3, hot_rows=n).collect())) for n in (4_000_000, 30))
    assert plain == split
    risk = lambda n: sorted(str(r) for r in e.risk_scores(rows, n, window_s=600, hosts=2).collect())
    assert risk(4_000_000) == risk(30)
    bob = e.entity_snapshot(rows, 600, 2, 2, shown_hosts=3).filter("entity_id = 'bob'").first()
    mine = rows.filter("actor = 'bob'").collect()
    names = sorted({r["source"] for r in mine} - {None, "unknown"})
    assert bob["event_count"] == len(mine) and bob["metadata"]["known_hosts"] == names[:3]
    assert bob["metadata"]["known_host_count"] == len(names) and "lateral_movement" in bob["metadata"]["deviation_flags"]
    assert bob["metadata"]["active_hours"] == sorted({r["timestamp"].hour for r in mine if r["timestamp"]})
    assert bob["metadata"]["known_event_types"] == sorted({r["event_type"] for r in mine} - {None})


def test_presence_of_an_item_ends_where_the_next_row_takes_over(spark):
    """Null items are items of their own, and rows without a time are not present."""
    rows = [("k", h, t, f"e{n:02d}") for n, (h, t) in enumerate([("a", 0), (None, 1), ("a", 2), (None, 3), ("b", 3), ("a", 4), ("c", None), ("b", 90)])]
    df = spark.createDataFrame([(k, h, t and t * 1_000_000 if t is not None else None, i) for k, h, t, i in rows],
                               "actor string, source string, _us long, event_id string")
    for hot in (4_000_000, 3):
        got = {r["event_id"]: r["n_hosts"] for r in recent_presence(df, "actor", "source", 60, 3, hot_rows=hot).collect()}
        assert [got[i] for *_, i in rows if i != "e06"] == [1, 2, 2, 2, 3, 3, 1] and got["e06"] == 0
