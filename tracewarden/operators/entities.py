"""Entity behaviour: deviations, risk, snapshots, timelines and as-of maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import fixed, predicates as p
from tracewarden.functions.text import entity_type, risk_label
from tracewarden.functions.times import instant, micros
from tracewarden.operators.correlate import alert_struct, emit, metadata, proof, unique_events
from tracewarden.operators.running import HOT_ROWS, Measured, placed, running_totals
from tracewarden.operators.sliding import SECOND, nth_following, present, recent_presence
from tracewarden.operators.spacing import greedy_spacing
from tracewarden.session import reliable, written

DAY = 86_400 * SECOND
SEVERITY = {
    "audit_log_cleared": "CRITICAL", "new_service": "HIGH", "new_account_created": "HIGH",
    "group_membership_change": "HIGH", "scheduled_task_created": "MEDIUM", "new_host_access": "MEDIUM",
    "after_hours_access": "MEDIUM", "stale_account_active": "HIGH", "success_after_failures": "HIGH",
}
# Flags of an event, by bit in ``marks``.
MARKS = ["new_host_access", "audit_log_cleared", "new_service", "new_account_created", "group_membership_change",
         "scheduled_task_created", "after_hours_access", "stale_account_active", "lateral_movement"]


def _named(marks: Column) -> Column:
    """The names of the flags in ``marks``."""
    return F.array_compact(F.array(*[F.when(marks.bitwiseAND(1 << k) > 0, F.lit(n)) for k, n in enumerate(MARKS)]))


def tracked(events: DataFrame) -> DataFrame:
    """Everything but low-severity noise of unknown actors."""
    return events.filter(~((F.col("actor") == "unknown") & (F.col("severity") < 3)))


def _branch() -> Column:
    """What kind of observation an event is; the branches exclude each other in this order."""
    return (
        F.when(p.failed_auth(), "auth_failure")
        .when(p.successful_auth(), "auth_success")
        .when(p.log_cleared(), "audit_log_cleared")
        .when(p.service_installed(), "new_service")
        .when(p.account_created(), "new_account_created")
        .when(p.group_add(), "group_membership_change")
        .when(p.task_created(), "scheduled_task_created")
        .when(F.col("severity") >= 7, "high_severity")
        .otherwise("plain")
    )


def observations(
    events: DataFrame,
    night_start: int = 22,
    night_end: int = 5,
    history: int = 10,
    stale_days: int = 90,
    hot_rows: int = HOT_ROWS,
    past: DataFrame | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Every tracked event with its place in the life of its actor: event number, failures so far, first time on the
    host, idle time before it, the deviation flags it raises and the risk it adds.

    ``past`` (actor, events, failures, reset, last_us) and ``pairs`` (actor, source) tell what came before ``events``,
    one row per key; see life_of."""
    rows = _watched(tracked(events))
    rows, hot_rows = placed(rows, "actor", hot_rows, tracked(events))
    seen = _observed(rows, tracked(events), night_start, night_end, history, stale_days, hot_rows, past, pairs)
    return seen.withColumn("flags", _named(F.col("marks"))).drop("marks")


def _watched(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "timestamp", "actor", "source", "target", "event_type", "severity", "raw_event_id", "description",
        micros(F.col("timestamp")).alias("_us"), _branch().alias("branch"),
    )


def _observed(
    rows: DataFrame, base: DataFrame, night_start: int = 22, night_end: int = 5, history: int = 10, stale_days: int = 90,
    hot_rows: int = HOT_ROWS, past: DataFrame | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """Observations of ``rows`` (of _watched, dealt by actor), with the flags as bits of ``marks``."""
    order = ["_us", "event_id"]
    rows = running_totals(rows, ["actor", "source"], order, {"_on_host": F.lit(1)}, hot_rows=hot_rows)
    rows = running_totals(
        rows, ["actor"], order,
        {"event_number": F.lit(1), "failures": F.when(F.col("branch") == "auth_failure", 1)},
        {"_last": F.col("_us")}, before=True, hot_rows=hot_rows, base=base,
    )
    if past is not None:
        earlier = past.select("actor", F.col("events").alias("_p_events"), F.col("failures").alias("_p_failures"),
                              F.col("last_us").alias("_p_last"))
        rows = rows.join(earlier, "actor", "left")
        rows = rows.join(pairs.select("actor", "source", F.lit(1).alias("_p_pair")), ["actor", "source"], "left")
        rows = rows.withColumns({
            "event_number": F.col("event_number") + F.coalesce("_p_events", F.lit(0)),
            "failures": F.col("failures") + F.coalesce("_p_failures", F.lit(0)),
            "_last_before": F.coalesce("_last_before", "_p_last"),
            "_on_host": F.col("_on_host") + F.coalesce("_p_pair", F.lit(0)),
        }).drop("_p_events", "_p_failures", "_p_last", "_p_pair")
    hour = F.hour("timestamp")
    auth = F.coalesce(F.col("event_type") == "auth", F.lit(False))
    flags = {
        "new_host_access": (F.col("branch") == "auth_success") & (F.col("_on_host") == 1) & (F.col("source") != "unknown"),
        **{k: F.col("branch") == k for k in (
            "audit_log_cleared", "new_service", "new_account_created", "group_membership_change",
            "scheduled_task_created",
        )},
        "after_hours_access": auth & (F.col("event_number") > history) & ((hour >= night_start) | (hour <= night_end)),
        "stale_account_active": auth & F.coalesce(F.col("_us") - F.col("_last_before") >= stale_days * DAY, F.lit(False)),
    }
    risk = F.when(F.col("branch").isin("auth_failure", "high_severity"), F.when(
        F.col("branch") == "auth_failure", fixed.RISK["auth_failure"]).otherwise(fixed.RISK["high_severity"])
    ).otherwise(0.0)
    for name, cond in flags.items():
        risk = risk + F.when(cond, fixed.RISK[name]).otherwise(0.0)
    marks = sum((F.when(c, 1 << MARKS.index(n)).otherwise(0) for n, c in flags.items()), F.lit(0))
    return rows.withColumns({"marks": marks, "risk_added": risk}).drop(
        "_on_host", "_last", "_last_before", "event_number_before", "failures_before"
    )


def life_of(seen: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(past, pairs) of some observations: sums and maxima per actor, so those of several batches add up (see merge_life)."""
    past = seen.groupBy("actor").agg(
        F.count("*").alias("events"), F.count_if(F.col("branch") == "auth_failure").alias("failures"),
        F.max("_us").alias("last_us"),
    ).join(runs.groupBy("actor").agg(F.max("failures").alias("reset")), "actor", "left")
    return past.select("actor", "events", "failures", "reset", "last_us"), seen.select("actor", "source").distinct()


def merge_life(past: DataFrame) -> DataFrame:
    return past.groupBy("actor").agg(
        F.sum("events").alias("events"), F.sum("failures").alias("failures"), F.max("reset").alias("reset"),
        F.max("last_us").alias("last_us"))


def success_after_failures(
    seen: DataFrame, threshold: int = 5, hot_rows: int = HOT_ROWS, past: DataFrame | None = None
) -> DataFrame:
    """Successes that end a run of at least ``threshold`` failures; a success resets the run only when it does.

    ``seen`` is observations(). Only the first success at each failure count can end a run, so the candidates are
    spaced on the failure count itself.
    """
    successes = seen.filter(F.col("branch") == "auth_success").filter(F.col("failures") >= threshold)
    if past is not None:
        resets = past.filter("reset IS NOT NULL").select("actor", F.col("reset").alias("_reset"))
        successes = successes.join(resets, "actor", "left").filter(
            F.col("failures") - F.coalesce("_reset", F.lit(0)) >= threshold)
    rest = ["event_id", "timestamp", "source", "target", "event_type", "severity", "description", "_us"]
    first = reliable(successes.groupBy("actor", "failures").agg(
        F.min_by(F.struct(*rest), F.struct("_us", "event_id")).alias("_e")
    ))
    counts = first.select("actor", "failures")
    if past is not None:
        counts = counts.unionByName(resets.withColumnRenamed("_reset", "failures"))
    kept = greedy_spacing(counts, ["actor"], "failures", threshold, initial=0, hot_rows=hot_rows)
    kept = running_totals(kept, ["actor"], ["failures"], peaks={"_reset": F.col("failures")}, before=True, hot_rows=hot_rows)
    kept = kept.select("actor", "failures", (F.col("failures") - F.coalesce("_reset_before", F.lit(0))).alias("run"))
    return first.join(kept, ["actor", "failures"]).select("actor", "failures", "run", "_e.*")


def _deviation_alert(flag: str, text: Column) -> Column:
    label = " ".join(w.capitalize() for w in flag.split("_"))
    return alert_struct(
        "entity", SEVERITY[flag], F.format_string(f"{label} - %s", "actor"), text, "", "", metadata(), proof("own", 0, True),
        alert_type=flag,
    )


def deviations(
    events: DataFrame, failure_threshold: int = 5, hot_rows: int = HOT_ROWS, seen: DataFrame | None = None,
    past: DataFrame | None = None, **hours
) -> DataFrame:
    """Candidate alerts for every deviation of an actor from its own history."""
    seen = reliable(observations(events, hot_rows=hot_rows, **hours)) if seen is None else seen
    return deviation_alerts(seen, success_after_failures(seen, failure_threshold, hot_rows, past), hours.get("stale_days", 90))


def deviation_alerts(seen: DataFrame, runs: DataFrame, stale_days: int = 90) -> DataFrame:
    """The alerts for flagged observations, and for ``runs`` of failures that a success ended."""
    texts = {
        "new_host_access": F.format_string("First seen on %s", "source"),
        "audit_log_cleared": F.lit("Security audit log was cleared"),
        "new_service": F.format_string("New service installed: %s", F.coalesce("description", F.lit(""))),
        "new_account_created": F.format_string("New user account created by %s", "actor"),
        "group_membership_change": F.format_string("%s added to security group", "actor"),
        "scheduled_task_created": F.format_string("Scheduled task created by %s", "actor"),
        "after_hours_access": F.concat(F.lit("Authentication at "), F.date_format("timestamp", "HH:mm"), F.lit(" UTC")),
        "stale_account_active": F.format_string("Account inactive for %s+ days, now active", F.lit(stale_days)),
    }
    hits = emit(seen, *[(F.array_contains("flags", n), _deviation_alert(n, t)) for n, t in texts.items()])
    text = F.format_string("%s failures before success", "run")
    return hits.unionByName(emit(runs, (F.lit(True), _deviation_alert("success_after_failures", text))))


def entity_lateral(
    events: DataFrame, window_s: int = 600, hosts: int = 3, last: int = 100, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Candidate alerts for actors on ``hosts`` or more distinct sources among their ``last`` events in the window."""
    used = events.filter("actor != 'unknown'")
    rows = used.select("event_id", "timestamp", "actor", "source", "target", "mitre_technique", "mitre_tactic",
                       micros(F.col("timestamp")).alias("_us"))
    rows = recent_presence(rows, "actor", "source", window_s, last, hot_rows).filter((F.col("n_hosts") >= hosts) & F.col("_us").isNotNull())
    text = F.format_string(f"%s authenticated to %s distinct hosts within {window_s // 60} minutes: {{hosts}}",
                           "actor", "n_hosts")
    return emit(rows, (F.lit(True), alert_struct(
        "entity_lateral", "CRITICAL", F.lit("{description}"), text, F.col("mitre_technique"), F.col("mitre_tactic"),
        metadata(host_count=F.col("n_hosts")), proof("own", 0, True), alert_type="lateral_movement",
    )))


def with_lateral(
    events: DataFrame, window_s: int = 600, hosts: int = 3, hot_rows: int = HOT_ROWS, last: int = 100, **hours
) -> tuple[DataFrame, Measured]:
    """Observations with lateral movement among their flags (bits of ``marks``) and in the risk they add; and ``hot_rows``, measured.

    What the windows need of the events is written once and filtered as it is read: a filter before the write would be pushed
    below the parser, and each event be parsed for the filter and once more for its row. Where no actor is hot, all windows
    share one shuffle, each row carries its observation through them, and ``last_on_host`` is true for one row of each
    pair of actor and source. With hot actors the rows that moved are joined to their observations, so that totals over
    pieces do not build on one another, and ``last_on_host`` is true for all.
    """
    rows = written(_watched(events).select("event_id", "timestamp", "actor", "source", "event_type", "severity", "branch"))
    base = rows = tracked(rows).drop("severity").withColumn("_us", micros(F.col("timestamp")))
    rows, hot_rows = placed(rows, "actor", hot_rows)
    known, whole = F.col("actor") != "unknown", F.col("event_id").isNotNull() & F.col("_us").isNotNull()
    if hot_rows.known[frozenset(["actor"])]:
        seen = _observed(rows, base, hot_rows=hot_rows, **hours)
        counted = recent_presence(base.filter(known).select("event_id", "actor", "source", "_us"), "actor", "source", window_s, last, hot_rows)
        moved = counted.filter(F.col("n_hosts") >= hosts).select("actor", "event_id", "_us", F.lit(True).alias("_moved"))
        seen = seen.join(moved, ["actor", "event_id", "_us"], "left").withColumns(
            {"_moved": F.col("_moved").isNotNull(), "last_on_host": F.lit(True)})
    else:
        rows = nth_following(rows, ["actor", "source"], 1, hot_rows, "_next")
        seen = nth_following(_observed(rows, base, hot_rows=hot_rows, **hours), "actor", last, hot_rows)
        seen = present(seen.withColumn("last_on_host", F.col("_next").isNull()), "actor", "source", window_s, known, hot_rows)
        seen = seen.withColumn("_moved", F.coalesce(known & whole & (F.col("n_hosts") >= hosts), F.lit(False))).drop("n_hosts")
    return seen.withColumns({
        "marks": F.when(F.col("_moved"), F.col("marks").bitwiseOR(1 << MARKS.index("lateral_movement"))).otherwise(F.col("marks")),
        "risk_added": F.col("risk_added") + F.when(F.col("_moved"), F.lit(fixed.RISK["lateral_movement"])).otherwise(0.0),
    }).drop("_moved"), hot_rows


def risk_added(
    events: DataFrame, window_s: int = 600, hosts: int = 3, hot_rows: int = HOT_ROWS, last: int = 100, **hours,
) -> DataFrame:
    """(actor, event_id, _us, timestamp, risk_added) per tracked event, lateral movement included."""
    seen, _ = with_lateral(events, window_s, hosts, hot_rows, last, **hours)
    return seen.select("actor", "event_id", "_us", "timestamp", "risk_added")


def risk_scores(events: DataFrame, hot_rows: int = HOT_ROWS, **options) -> DataFrame:
    """Risk of the actor after each of its events. Risk only grows here, so the ceiling is applied to the total."""
    rows = risk_added(unique_events(events), hot_rows=hot_rows, **options)
    rows = running_totals(rows, ["actor"], ["_us", "event_id"], {"_sum": F.col("risk_added")}, hot_rows=hot_rows)
    score = F.round(F.least(F.lit(fixed.RISK_CEILING), F.col("_sum")), 2)
    return rows.select("actor", "event_id", "timestamp", "risk_added", score.alias("risk_score"),
                       risk_label(score).alias("risk_label"))


def entity_snapshot(
    events: DataFrame, window_s: int = 600, hosts: int = 3, failure_threshold: int = 5, shown_hosts: int = 20,
    hot_rows: int = HOT_ROWS, **hours,
) -> DataFrame:
    """One row per actor, and per source host that never acts itself (with event_count 0).

    Sets stay small by construction (hours, types, flags); hosts are cut to ``shown_hosts`` names before they are
    gathered, next to their exact number; ``entity_hosts`` has all.
    """
    seen, hot_rows = with_lateral(unique_events(events), window_s, hosts, hot_rows, **hours)
    # Only what the sums below read is written, and they read only their own columns of it.
    seen = written(seen.select(
        "actor", "source", "timestamp", "event_type", "branch", "failures", "marks", "risk_added", "last_on_host"))
    ends = seen.filter((F.col("branch") == "auth_success") & (F.col("failures") >= failure_threshold)).select("actor", "failures")
    reset = greedy_spacing(ends, ["actor"], "failures", failure_threshold, initial=0, hot_rows=hot_rows).groupBy("actor").agg(
        F.max("failures").alias("reset"))
    # Numbers are summed by actor and kind of event first: they need no sets, and few rows are left for the names of kinds.
    life = seen.groupBy("actor", "event_type").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("events"),
        F.count_if(F.col("branch") == "auth_failure").alias("failures"),
        F.count_if(F.col("branch") == "auth_success").alias("successes"),
        F.bit_or(F.expr("shiftleft(1, hour(timestamp))")).alias("hours"), F.bit_or("marks").alias("marks"),
        F.sum("risk_added").alias("risk"), F.max(F.when(F.col("risk_added") > 0, F.col("timestamp"))).alias("risk_at"),
    ).groupBy("actor").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"),
        F.sum("failures").alias("failures"), F.sum("successes").alias("successes"), F.bit_or("hours").alias("hours"),
        F.collect_set("event_type").alias("types"), F.bit_or("marks").alias("marks"), F.sum("risk").alias("risk"),
        F.max("risk_at").alias("risk_at"),
    ).withColumns({
        "hours": F.array_compact(F.array(*[F.when(F.col("hours").bitwiseAND(1 << h) != 0, F.lit(h)) for h in range(24)])),
        "flags": _named(F.col("marks")),
    }).drop("marks")
    placed_on = seen.filter("source != 'unknown'")
    # With hot actors more than one row of a pair says to be the last.
    pairs = placed_on.filter("last_on_host").select("actor", "source")
    pairs = pairs.distinct() if hot_rows.known[frozenset(["actor"])] else pairs
    w = Window.partitionBy("actor").orderBy("source")
    known = pairs.withColumn("_n", F.row_number().over(w)).groupBy("actor").agg(
        F.collect_list(F.when(F.col("_n") <= shown_hosts, F.col("source"))).alias("hosts"), F.count("*").alias("host_count"))
    ended = F.when(F.col("reset").isNotNull(), F.array(F.lit("success_after_failures"))).otherwise(F.array().cast("array<string>"))
    actors = life.join(reset, "actor", "left").join(known, "actor", "left").withColumn("flags", F.concat("flags", ended))
    return snapshot_rows(actors, placed_on.groupBy("source").agg(F.min("timestamp").alias("first_seen")))


def entity_hosts(seen: DataFrame) -> DataFrame:
    """(actor, source, first_seen): every host that an actor was seen on."""
    return seen.filter("source != 'unknown'").groupBy("actor", "source").agg(F.min("timestamp").alias("first_seen"))


def snapshot_rows(actors: DataFrame, sources: DataFrame) -> DataFrame:
    """The snapshot from what is known of each actor, and of each source (source, first_seen) anyone was seen on."""
    nothing = F.array().cast("array<string>")
    names = lambda c: F.sort_array(F.array_distinct(F.coalesce(c, nothing)))
    meta = F.struct(
        (F.col("failures") - F.coalesce("reset", F.lit(0))).alias("auth_failures"), F.col("successes").alias("auth_successes"),
        names("hosts").alias("known_hosts"), F.coalesce("host_count", F.lit(0).cast("long")).alias("known_host_count"),
        F.sort_array("hours").alias("active_hours"), names("flags").alias("deviation_flags"), F.sort_array("types").alias("known_event_types"),
    )
    acting = actors.select(
        F.col("actor").alias("entity_id"), "first_seen", "last_seen", F.col("events").alias("event_count"),
        F.round(F.least(F.lit(fixed.RISK_CEILING), "risk"), 2).alias("risk_score"),
        F.coalesce("risk_at", "first_seen").alias("last_risk_update"), meta.alias("metadata"),
    )
    zero = F.lit(0).cast("long")
    passive_meta = F.struct(
        zero.alias("auth_failures"), zero.alias("auth_successes"), nothing.alias("known_hosts"),
        zero.alias("known_host_count"), F.array().cast("array<int>").alias("active_hours"),
        nothing.alias("deviation_flags"), nothing.alias("known_event_types"),
    )
    # A source that acts has a row of its own already, also if it is the only one to be seen on itself.
    passive = sources.join(actors.select(F.col("actor").alias("source")), "source", "left_anti").select(
        F.col("source").alias("entity_id"), "first_seen", F.col("first_seen").alias("last_seen"),
        zero.alias("event_count"), F.lit(0.0).alias("risk_score"),
        F.col("first_seen").alias("last_risk_update"), passive_meta.alias("metadata"))
    return acting.unionByName(passive).select(
        "entity_id", entity_type(F.col("entity_id")).alias("entity_type"), "first_seen", "last_seen", "event_count",
        "risk_score", risk_label(F.col("risk_score")).alias("risk_label"), F.lit(False).alias("is_stale"),
        F.array().cast("array<string>").alias("tags"), "metadata", "last_risk_update",
    )


def entity_timeline(
    events: DataFrame, min_severity: int = 4, failure_threshold: int = 5, hot_rows: int = HOT_ROWS,
    seen: DataFrame | None = None, **hours
) -> DataFrame:
    """The significant events of every entity: severe enough, or deviating."""
    seen = reliable(observations(events, hot_rows=hot_rows, **hours)) if seen is None else seen
    columns = ["actor", "timestamp", "event_id", "event_type", "target", "source", "severity", "description"]
    loud = (F.col("severity") >= min_severity) | (F.size("flags") > 0)
    runs = success_after_failures(seen.filter(F.col("branch").isin("auth_success", "auth_failure")), failure_threshold, hot_rows)
    quiet = seen.filter(~loud).join(runs.select("actor", "event_id", "_us"), ["actor", "event_id", "_us"], "left_semi")
    rows = seen.filter(loud).select(*columns).unionByName(quiet.select(*columns))
    return rows.withColumnsRenamed({"actor": "entity_id", "source": "source_host"})


# ---- As-of maintenance and reports over a snapshot ----

def decay(snapshot: DataFrame, as_of, after_hours: int = 24) -> DataFrame:
    """Lower the risk of entities idle for ``after_hours`` or more, by the hour since their risk last rose."""
    idle = (micros(instant(as_of)) - micros(F.col("last_risk_update"))) / F.lit(3600.0 * SECOND)
    lowered = F.greatest(F.lit(0.0), F.col("risk_score") - fixed.RISK_DECAY_PER_HOUR * idle)
    score = F.when(idle >= after_hours, lowered).otherwise(F.col("risk_score"))
    changed = score < F.col("risk_score")
    return snapshot.withColumns({
        "risk_score": F.round(score, 2), "risk_label": risk_label(F.round(score, 2)),
        "last_risk_update": F.when(changed, instant(as_of)).otherwise(F.col("last_risk_update")),
    })


def mark_stale(snapshot: DataFrame, as_of, days: int = 90) -> DataFrame:
    limit = instant(as_of) - F.make_dt_interval(days=F.lit(days))
    return snapshot.withColumn("is_stale", F.col("last_seen") < limit)


def top_risk(snapshot: DataFrame, n: int = 20, type: str | None = None) -> DataFrame:
    used = snapshot if type is None else snapshot.filter(F.col("entity_type") == type)
    return used.orderBy(F.desc("risk_score"), "entity_id").limit(n)


def entity_stats(snapshot: DataFrame) -> DataFrame:
    """Counts by measure: total, stale, per type and per risk label."""
    def one(measure: str, name, n) -> Column:
        return F.struct(F.lit(measure).alias("measure"), name.alias("name"), n.alias("n"))

    none, single = F.lit(""), F.lit(1)
    return snapshot.select(F.explode(F.array(
        one("total", none, single), one("type", F.col("entity_type"), single),
        one("risk_label", F.col("risk_label"), single), one("stale", none, F.col("is_stale").cast("int")),
    )).alias("m")).groupBy("m.measure", "m.name").agg(F.sum("m.n").alias("count"))
