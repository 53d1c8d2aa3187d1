"""The skew path must give what the plain path gives, and both what a brute-force loop gives."""

import random

from pyspark.sql import functions as F

from tracewarden.operators import correlate as c
from tracewarden.operators import entities as e
from tracewarden.operators.running import running_totals
from tracewarden.operators.sliding import nth_following, recent_presence, sliding_counts
from tracewarden.operators.spacing import greedy_spacing


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def skewed(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}", rnd.choice("abcdef"), rnd.randrange(4000) * 1_000_000, f"{i:05d}")
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "actor string, source string, _us long, event_id string")


def test_running_totals_hot_equals_plain(spark):
    _, df = skewed(spark)
    for order in (["_us"], ["_us", "event_id"]):
        args = (["actor"], order, {"n": F.lit(1)}, {"m": F.col("_us")}, True)
        plain = running_totals(df, *args)
        split = running_totals(df, *args, hot_rows=40).select(*plain.columns)
        assert rows_of(plain) == rows_of(split)


def test_one_moment_holds_most_rows(spark):
    df = spark.range(3000).select(F.lit("k").alias("actor"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("_us"),
                                  F.col("id").cast("string").alias("event_id"))
    args = (["actor"], ["_us"], {"n": F.lit(1)}, {}, True)
    plain = running_totals(df, *args)
    assert rows_of(plain) == rows_of(running_totals(df, *args, hot_rows=100).select(*plain.columns))


def test_sliding_counts_brute_force(spark):
    rows, df = skewed(spark, 300)
    window = 120
    for hot in (30, 4_000_000):
        got = {r["event_id"]: (r["n_a"], r["n_all"]) for r in sliding_counts(
            df, ["actor"], {"a": F.col("source") == "a", "all": F.lit(True)}, window, hot_rows=hot).collect()}
        assert len(got) == len(rows)
        for actor, _, us, i in rows:
            near = [r for r in rows if r[0] == actor and us - window * 1_000_000 <= r[2] <= us]
            assert got[i] == (sum(r[1] == "a" for r in near), len(near))


def test_recent_presence_brute_force(spark):
    rows, df = skewed(spark, 300)
    window, last = 200, 7
    for hot in (30, 4_000_000):
        counted = recent_presence(df, "actor", "source", window, last, hot_rows=hot)
        got = {r["event_id"]: r["n_hosts"] for r in counted.collect()}
        for actor, _, us, i in rows:
            own = sorted(((r[2], r[3], r[1]) for r in rows if r[0] == actor and (r[2], r[3]) <= (us, i)))[-last:]
            assert got[i] == len({s for t, _, s in own if t >= us - window * 1_000_000})


def test_nth_following_hot_equals_plain(spark):
    _, df = skewed(spark, 200)
    plain = nth_following(df, "actor", 5)
    assert rows_of(plain) == rows_of(nth_following(df, "actor", 5, hot_rows=20).select(*plain.columns))


def spaced(values, gap, last=None):
    out = []
    for v in sorted(set(values)):
        if last is None or v - last >= gap:
            out.append(v)
            last = v
    return out


def test_greedy_spacing(spark):
    rows, df = skewed(spark, 500)
    for hot in (50, 4_000_000):
        for initial in (None, 0):
            gap = 90_000_000
            got = greedy_spacing(df, ["actor"], "_us", gap, initial, hot_rows=hot).collect()
            for actor in {r[0] for r in rows}:
                want = spaced([r[2] for r in rows if r[0] == actor], gap, initial)
                assert sorted(r["_us"] for r in got if r["actor"] == actor) == want


def test_spacing_boundary(spark):
    df = spark.createDataFrame([("k", v) for v in (0, 299, 300, 301, 599, 600)], "actor string, v long")
    assert sorted(r["v"] for r in greedy_spacing(df, ["actor"], "v", 300).collect()) == [0, 300, 600]


def test_detectors_hot_equal_plain(events):
    window = 86_400
    for fn in (
        lambda hot: c.correlate(events, window, 3, 2, 2, hot_rows=hot),
        lambda hot: e.deviations(events, 2, hot_rows=hot, stale_days=7),
        lambda hot: e.entity_lateral(events, window, 2, hot_rows=hot),
        lambda hot: e.risk_scores(events, window_s=window, hosts=2, hot_rows=hot),
    ):
        plain, split = fn(4_000_000), fn(45)
        pick = [x for x in plain.columns if x not in ("metadata", "proof")]
        assert rows_of(plain.select(*pick)) == rows_of(split.select(*pick))


def with_nulls(spark):
    rows, _ = skewed(spark, 400)
    rows += [(None, "a", i * 1_000_000, f"n{i}") for i in range(120)] + [("hot", "b", None, f"t{i}") for i in range(60)]
    rows += [(None, None, None, f"z{i}") for i in range(50)] + rows[:30]
    return rows, spark.createDataFrame(rows, "actor string, source string, _us long, event_id string")


def test_nulls_and_copies_on_both_paths(spark):
    rows, df = with_nulls(spark)
    args = (["actor"], ["_us"], {"n": F.lit(1)}, {"m": F.col("_us")}, True)
    plain = running_totals(df, *args)
    assert plain.count() == len(rows)
    for hot in (20, 100):
        assert rows_of(plain) == rows_of(running_totals(df, *args, hot_rows=hot).select(*plain.columns))


def test_spacing_keeps_null_keys(spark):
    rows, df = with_nulls(spark)
    df = df.filter("_us IS NOT NULL")
    gap = 90_000_000
    want = set()
    for actor in {r[0] for r in rows}:
        last = None
        for us in sorted(r[2] for r in rows if r[0] == actor and r[2] is not None):
            if last is None or us - last >= gap:
                want.add((actor, us))
                last = us
    for hot in (25, 4_000_000):
        assert {tuple(r) for r in greedy_spacing(df.select("actor", "_us"), ["actor"], "_us", gap, hot_rows=hot).collect()} == want


def test_cooldown_keeps_null_keys(spark, make):
    events = make([(i * 400, None if i % 2 else "bob", None, 1102) for i in range(8)])
    found = c.audit_log_cleared(events)
    kept = c.cooldown(found, 300).collect()
    assert len(kept) == 8 and sum(r["actor"] is None for r in kept) == 4


def test_copies_of_events_change_nothing(spark, make):
    from tracewarden.plans.detection import detect

    events = make([(i * 20, "bob", f"h{i % 4}", 4625 if i % 3 else 4624) for i in range(60)])
    later = events.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 SECONDS"))
    options = {"window_s": 600, "hosts": 2, "brute_force_threshold": 5}
    once = detect(events, **options).select("alert_id", "timestamp", "description", "event_ids")
    thrice = detect(events.unionByName(events).unionByName(later), **options).select("alert_id", "timestamp", "description", "event_ids")
    assert rows_of(once) == rows_of(thrice)
    risk = e.risk_scores(events.unionByName(events), window_s=600, hosts=2)
    assert rows_of(risk) == rows_of(e.risk_scores(events, window_s=600, hosts=2))


def test_known_sources_are_the_first_by_name(spark, make):
    from tracewarden.plans.detection import detect

    rows = [(i, "bob", f"s{99 - i:02d}", 4624) for i in range(30)] + [(40, "bob", "new", 4624), (700, "bob", "next", 4624)]
    alerts = {r["source_host"]: r for r in c.finalise(
        c.new_source_auth(make(rows), 600, 5).filter("source_host IN ('new', 'next')"), make(rows), 600).collect()}
    names = [f"s{k}" for k in range(70, 100)]
    assert alerts["new"]["metadata"]["known_sources"] == ",".join(names[:10])
    assert "s70, s71, s72" in alerts["new"]["description"]
    assert "next" not in alerts or alerts["next"]["metadata"]["known_sources"].startswith("new")
    busy = make([(i, "ann", f"h{i:03d}", 4624) for i in range(130)])
    lateral = detect(busy, window_s=600, cooldown_s=1, hosts=120).filter("alert_type = 'lateral_movement'").collect()
    assert lateral and all(len(r["distinct_hosts"]) <= 100 and int(r["metadata"]["host_count"]) >= 120 for r in lateral if r["stage"] < 30_000)


def test_known_sources_of_a_wide_slice_in_pieces(spark, make):
    rnd = random.Random(3)
    rows = [(rnd.randrange(1200), rnd.choice(["bob", "bob", "ann"]), f"s{rnd.randrange(400):03d}", 4624) for _ in range(900)]
    rows += [(1150, "bob", "new", 4624), (5, "carl", "s001", 4624), (6, None, "s002", 4624)]
    events = make(rows)
    alerts = events.withColumn("alert_id", F.col("event_id")).withColumn("source_host", F.col("source"))
    want = {}
    for i, (at, actor, host, _) in enumerate(rows):
        names = sorted({s for t, a, s, _ in rows if a == actor and s != host and at - 600 <= t <= at})
        want[f"e{i:04d}"] = names[:10]
    for piece in (50_000, 20, 3):
        got = {r.alert_id: r.known_sources for r in c.known_sources(alerts, events, 600, piece_rows=piece).collect()}
        assert got == {i: n for i, n in want.items() if n}


def test_known_sources_ignore_events_without_a_time(spark, make):
    events = make([(i, "bob", f"s{i}", 4624) for i in range(4)])
    untimed = make([(9, "bob", "s0x", 4624)]).withColumns({"timestamp": F.lit(None).cast("timestamp"), "event_id": F.lit("n")})
    events = events.unionByName(untimed)
    alerts = events.withColumn("alert_id", F.col("event_id")).withColumn("source_host", F.col("source"))
    got = {r.alert_id: r.known_sources for r in c.known_sources(alerts, events, 600).collect()}
    assert got == {"e0001": ["s0"], "e0002": ["s0", "s1"], "e0003": ["s0", "s1", "s2"]}


def _greedy(moments, gap):
    kept, last = set(), None
    for at in sorted(moments):
        if last is None or at - last >= gap:
            kept.add(at)
            last = at
    return kept


def test_cooldown_of_chains_brute_force(spark, make):
    """Chains of close alerts, two alerts of one moment, and alerts without a time, with keys in one task and in pieces."""
    rnd = random.Random(8)
    rows = [(rnd.choice([rnd.randrange(400), rnd.randrange(5_000)]), rnd.choice(["ann", "bob", None]), rnd.choice(["h1", "h2"]), 1102)
            for _ in range(400)]
    events = make(rows)
    untimed = make([(0, "ann", "h1", 1102), (1, "ann", "h1", 1102)]).withColumns(
        {"timestamp": F.lit(None).cast("timestamp"), "event_id": F.concat(F.lit("n"), "event_id")})
    found = c.audit_log_cleared(events.unionByName(untimed))
    want = {(actor, host, at) for actor in ("ann", "bob", None) for host in ("h1", "h2")
            for at in _greedy({r[0] for r in rows if r[1] == actor and r[2] == host}, 60)}
    first = {}
    for i, (at, actor, host, _) in enumerate(rows):
        first.setdefault((actor, host, at), f"e{i:04d}")
    for hot in (4_000_000, 20):
        kept = c.cooldown(found, 60, hot).select(
            "actor", "source_host", "event_id", (F.unix_timestamp("timestamp") - F.lit(1705320000)).alias("at")).collect()
        timed = [r for r in kept if r.at is not None]
        assert {(r.actor, r.source_host, r.at) for r in timed} == want and len(timed) == len(want)
        assert all(first[r.actor, r.source_host, r.at] == r.event_id for r in timed)
        assert [r.event_id for r in kept if r.at is None] == ["ne0000"]


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_of_one_actor_share_a_shuffle(make):
    events = make([(i, "ann", f"h{i % 3}", 4624) for i in range(20)])
    assert _shuffles(c.actor_windows(c.traced(events), 600)) == 1
    assert _shuffles(e.observations(events)) == 1
    assert _shuffles(e.entity_lateral(events, 600, 2)) == 1
