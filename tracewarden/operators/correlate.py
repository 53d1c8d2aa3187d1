"""Multi-event detectors over event-time windows, alert cooldown, evidence and final alerts.

Detectors run in two phases. First only counts travel with each event; after the cooldown the few surviving alerts
fetch their evidence. Evidence is fetched by number: an alert knows it wants failures 41..50 of its actor, so the join
is on unique keys and an alert meets at most ten events, however busy the actor is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import fixed, predicates as p
from tracewarden.functions.times import micros
from tracewarden.operators.host_lists import first_hosts
from tracewarden.operators.running import HOT_ROWS, hot_keys, placed, running_totals
from tracewarden.operators.sliding import SECOND, presence, sliding_counts, spans
from tracewarden.operators.spacing import greedy_spacing
from tracewarden.session import join_null_safe, reliable, written

CANDIDATE = [
    "stage", "alert_type", "severity", "severity_score", "title", "description", "actor", "target", "source_host",
    "timestamp", "event_id", "sigma_rule_id", "mitre_technique", "mitre_tactic", "metadata", "proof",
]
# Sources of one actor and time slice that are pruned in one task.
PIECE_ROWS = 50_000
_NO_NAME = np.int64(2**62)  # after every rank
# Order in which the detectors of one event are asked; the first of a kind wins the cooldown.
STAGE = {
    "entity": 0, "sigma": 10_000, "brute_force": 20_001, "credential_stuffing": 20_002, "lateral_movement": 20_003,
    "privilege_escalation_chain": 20_004, "persistence_after_auth": 20_005, "audit_log_cleared": 20_006,
    "after_hours_auth": 20_007, "new_source_auth": 20_008, "entity_lateral": 30_000,
}


def traced(events: DataFrame) -> DataFrame:
    """The narrow form the detectors shuffle: no payload, no description, one flag per event class."""
    flags = {
        "fail": p.failed_auth(), "ok": p.successful_auth(), "auth": p.any_auth(), "logon": p.windows_logon(),
        "group_add": p.group_add(), "service": p.service_installed(), "task": p.task_created(),
        "cleared": p.log_cleared(),
    }
    return events.select(
        "event_id", "timestamp", "actor", "source", "target", micros(F.col("timestamp")).alias("_us"),
        *[c.alias(n) for n, c in flags.items()],
    )


def metadata(**items: Column) -> Column:
    """Text map of the given values, without the null ones."""
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def proof(kind: str, take: int, own: bool, n: Column | None = None, upto: Column | None = None) -> Column:
    """Which events prove an alert: the last ``take`` of ``n`` windowed events of a kind, plus its own if ``own``."""
    none = F.lit(None).cast("long")
    n = none if n is None else n.cast("long")
    upto = none if upto is None else upto.cast("long")
    return F.struct(
        F.lit(kind).alias("kind"), upto.alias("upto"), n.alias("n"), F.lit(take).alias("take"), F.lit(own).alias("own")
    )


def alert_struct(
    name: str, severity, title: Column, description: Column, technique, tactic, meta: Column, proof_: Column,
    alert_type: str | None = None,
) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    score = F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_SCORE.items() for x in kv])
    technique = F.lit(technique) if isinstance(technique, str) else technique
    tactic = F.lit(tactic) if isinstance(tactic, str) else tactic
    return F.struct(
        F.lit(STAGE[name]).alias("stage"), F.lit(alert_type or name).alias("alert_type"), severity.alias("severity"),
        score[severity].alias("severity_score"), title.alias("title"), description.alias("description"),
        F.col("actor"), F.col("target"), F.col("source").alias("source_host"), F.col("timestamp"), F.col("event_id"),
        F.lit(None).cast("string").alias("sigma_rule_id"), technique.alias("mitre_technique"), tactic.alias("mitre_tactic"),
        meta.alias("metadata"), proof_.alias("proof"),
    )


def emit(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """One row per rule that holds on a row, all rules in a single pass.

    Numbers of rules are exploded, and an alert is made for a number: an array of alerts finds its type anew for every row.
    """
    number = F.explode(F.array(*[F.when(cond, F.lit(i)) for i, (cond, _) in enumerate(rules)]))
    hits = df.withColumn("_hit", number).filter("_hit IS NOT NULL")
    alert = F
    for i, (_, made) in enumerate(rules):
        alert = alert.when(F.col("_hit") == i, made)
    return hits.select(alert.alias("_a")).select("_a.*").select(*CANDIDATE)


def _f(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *cols)


# ---- The rules: (condition, alert) over the counted rows ----

def _brute_force(threshold: int):
    n = F.col("n_fail")
    return F.col("fail") & (n >= threshold), alert_struct(
        "brute_force", "HIGH", _f("Brute Force Attack - %s", "actor"),
        _f("%s failed authentication attempts against '%s' from %s within {span}s", n, "actor", "source"),
        "T1110", "credential-access", metadata(failure_count=n, threshold=F.lit(threshold)),
        proof("fail", 10, False, n, F.col("upto_fail")),
    )


def _credential_stuffing(threshold: int):
    n = F.col("n_fail")
    return F.col("ok") & (n >= threshold), alert_struct(
        "credential_stuffing", "CRITICAL", _f("Successful Login After Failures - %s", "actor"),
        _f("Account '%s' logged in from %s after %s failed attempts: a guessed or stolen password is likely.",
           "actor", "source", n),
        "T1110.004", "credential-access", metadata(failure_count=n), proof("fail", 5, True, n, F.col("upto_fail")),
    )


def _lateral_movement(hosts: int):
    n = F.col("n_hosts")
    return F.col("auth") & (n >= hosts), alert_struct(
        "lateral_movement", "CRITICAL", _f("Lateral Movement - %s", "actor"),
        _f("Actor '%s' authenticated to %s distinct hosts within {span}s: {hosts}", "actor", n),
        "T1021", "lateral-movement", metadata(host_count=n),
        proof("auth", 10, False, F.col("n_auth"), F.col("upto_auth")),
    )


def _escalation_chain():
    n = F.col("n_logon")
    return F.col("group_add") & (n >= 1), alert_struct(
        "privilege_escalation_chain", "CRITICAL", _f("Privilege Escalation Chain - %s", "actor"),
        _f("Actor '%s' logged in and was added to a security group shortly afterwards.", "actor"),
        "T1078", "privilege-escalation", metadata(login_count=n), proof("logon", 3, True, n, F.col("upto_logon")),
    )


def _persistence_after_auth():
    n = F.col("n_auth")
    kind = F.when(F.col("service"), "service installation").otherwise("scheduled task creation")
    return (F.col("service") | F.col("task")) & (n >= 1), alert_struct(
        "persistence_after_auth", "HIGH", _f("Persistence After Auth - %s", "source"),
        _f("%s on '%s' followed a recent authentication on the same host.", F.initcap(kind), "source"),
        F.when(F.col("service"), "T1543").otherwise("T1053"), "persistence",
        metadata(persistence_type=kind, recent_auth_count=n), proof("host_auth", 3, True, n, F.col("upto_auth")),
    )


def _audit_log_cleared():
    return F.col("cleared"), alert_struct(
        "audit_log_cleared", "CRITICAL", _f("Audit Log Cleared - %s", "source"),
        _f("The Windows security audit log on '%s' was cleared by '%s'.", "source", "actor"),
        "T1070.001", "defense-evasion", metadata(), proof("own", 0, True),
    )


def _after_hours_auth(start: int, end: int, history: int):
    hour = F.hour("timestamp")
    outside = (hour < start) | (hour >= end)
    return F.col("auth") & outside & (F.col("n_all") >= history), alert_struct(
        "after_hours_auth", "MEDIUM", _f("After-Hours Authentication - %s", "actor"),
        _f(f"Actor '%s' authenticated to '%s' at %s UTC, outside {start:02d}:00-{end:02d}:00.", "actor", "source",
           F.date_format("timestamp", "HH:mm")),
        "T1078", "defense-evasion",
        metadata(auth_hour=hour, business_start=F.lit(start), business_end=F.lit(end)), proof("own", 0, True),
    )


def _new_source_auth(history: int):
    fresh = F.col("auth") & (F.col("source") != "unknown") & (F.col("n_pair") == 1) & (F.col("n_all") >= history)
    return fresh, alert_struct(
        "new_source_auth", "MEDIUM", _f("Authentication From New Source - %s", "actor"),
        _f("Actor '%s' authenticated from a new source '%s'. Known sources: {known}.", "actor", "source"),
        "T1078", "initial-access", metadata(new_source=F.col("source")), proof("own", 0, True),
    )


# ---- Windows shared by the rules ----

def actor_windows(trace: DataFrame, window_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every count the per-actor rules need, in two scans: per (actor, source), then per actor."""
    trace, hot_rows = placed(trace, "actor", hot_rows)
    rows = presence(trace, "actor", "source", window_s, F.col("auth"), hot_rows)
    counts = {"fail": F.col("fail"), "logon": F.col("logon"), "auth": F.col("auth"), "all": F.lit(True)}
    return sliding_counts(rows, ["actor"], counts, window_s, hot_rows=hot_rows, base=trace)


def host_windows(trace: DataFrame, window_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Authentications per source host; only authentications and persistence events are shuffled."""
    used, hot_rows = placed(trace.filter("auth OR service OR task"), "source", hot_rows)
    return sliding_counts(used, ["source"], {"auth": F.col("auth")}, window_s, hot_rows=hot_rows)


# ---- Public detectors: events -> candidate alerts ----

def brute_force(events: DataFrame, window_s: int = 600, threshold: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    failures = traced(events).filter("fail")
    rows = sliding_counts(failures, ["actor"], {"fail": F.col("fail")}, window_s, hot_rows=hot_rows)
    return emit(rows, _brute_force(threshold))


def credential_stuffing(
    events: DataFrame, window_s: int = 600, threshold: int = 5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    used = traced(events).filter("fail OR ok")
    rows = sliding_counts(used, ["actor"], {"fail": F.col("fail")}, window_s, hot_rows=hot_rows)
    return emit(rows, _credential_stuffing(threshold))


def lateral_movement(events: DataFrame, window_s: int = 600, hosts: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    used = traced(events).filter("auth")
    rows = presence(used, "actor", "source", window_s, F.col("auth"), hot_rows)
    rows = sliding_counts(rows, ["actor"], {"auth": F.col("auth")}, window_s, hot_rows=hot_rows, base=used)
    return emit(rows, _lateral_movement(hosts))


def escalation_chain(events: DataFrame, window_s: int = 600, hot_rows: int = HOT_ROWS) -> DataFrame:
    used = traced(events).filter("logon OR group_add")
    rows = sliding_counts(used, ["actor"], {"logon": F.col("logon")}, window_s, hot_rows=hot_rows)
    return emit(rows, _escalation_chain())


def persistence_after_auth(events: DataFrame, window_s: int = 600, hot_rows: int = HOT_ROWS) -> DataFrame:
    return emit(host_windows(traced(events), window_s, hot_rows), _persistence_after_auth())


def audit_log_cleared(events: DataFrame) -> DataFrame:
    return emit(traced(events.filter(p.log_cleared())), _audit_log_cleared())


def after_hours_auth(
    events: DataFrame, window_s: int = 600, start: int = 7, end: int = 18, history: int = 3, hot_rows: int = HOT_ROWS
) -> DataFrame:
    rows = sliding_counts(traced(events), ["actor"], {"all": F.lit(True)}, window_s, hot_rows=hot_rows)
    return emit(rows, _after_hours_auth(start, end, history))


def new_source_auth(events: DataFrame, window_s: int = 600, history: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    rows = sliding_counts(
        traced(events), ["actor", "source"], {"pair": F.lit(True)}, window_s, hot_rows=hot_rows
    ).drop("upto_pair")
    rows = sliding_counts(rows, ["actor"], {"all": F.lit(True)}, window_s, hot_rows=hot_rows, base=traced(events))
    return emit(rows, _new_source_auth(history))


def global_window(events: DataFrame, window_s: int = 600, event_type: str | None = None) -> DataFrame:
    """All events in tumbling windows, optionally of one type: counts, actors and sources per window."""
    used = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return used.groupBy(F.window("timestamp", f"{window_s} seconds").alias("w")).agg(
        F.count("*").alias("events"), F.max("severity").alias("max_severity"),
        F.countDistinct("actor").alias("actors"), F.countDistinct("source").alias("sources"),
    ).select("w.start", "w.end", "events", "max_severity", "actors", "sources")


_CUSTOM: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """Add a custom rule: a function from events to candidate alerts (columns CANDIDATE)."""
    _CUSTOM[name] = rule


def unregister(name: str) -> None:
    _CUSTOM.pop(name, None)


def correlate(
    events: DataFrame,
    window_s: int = 600,
    brute_force_threshold: int = 10,
    stuffing_threshold: int = 5,
    hosts: int = 3,
    business_start: int = 7,
    business_end: int = 18,
    after_hours_history: int = 3,
    new_source_history: int = 5,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All eight rules and the registered custom ones. The per-actor rules share one scan."""
    trace = traced(events)
    out = emit(
        actor_windows(trace, window_s, hot_rows),
        _brute_force(brute_force_threshold), _credential_stuffing(stuffing_threshold), _lateral_movement(hosts),
        _escalation_chain(), _audit_log_cleared(),
        _after_hours_auth(business_start, business_end, after_hours_history), _new_source_auth(new_source_history),
    ).unionByName(emit(host_windows(trace, window_s, hot_rows), _persistence_after_auth()))
    for rule in _CUSTOM.values():
        out = out.unionByName(rule(events).select(*CANDIDATE))
    return out


# ---- Cooldown ----

COOLDOWN_KEYS = ["alert_type", "actor", "source_host"]


def cooldown(alerts: DataFrame, seconds: int = 300, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep an alert when ``seconds`` have passed since the last kept one of the same type, actor and source host.

    Of the alerts of one moment the first by (event_id, stage) counts. Those without a time are one moment that cools nothing.
    """
    order, gap = alerts.columns, seconds * SECOND
    alerts = alerts.withColumn("_us", micros(F.col("timestamp")))
    if hot_keys(alerts.select(*COOLDOWN_KEYS), COOLDOWN_KEYS, hot_rows) is not None:
        return _cooled_by_joins(alerts, gap, hot_rows).select(*order)
    # One shuffle of the alerts. Rows closer than the gap form a chain: its first moment is kept, what follows within the gap is
    # not, and only the moments beyond are left to the greedy choice.
    w = Window.partitionBy(*COOLDOWN_KEYS).orderBy("_us", "event_id", "stage")
    rows = alerts.withColumns({"_before": F.lag("_us").over(w), "_first": F.lag(F.lit(False), 1, True).over(w)})
    rows = rows.withColumn("_moment", F.col("_first") | ~F.col("_us").eqNullSafe(F.col("_before")))
    begins = F.col("_moment") & (F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= gap))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_chain", F.max(F.when(begins, F.col("_us"))).over(upto))
    rows = rows.withColumn("_since", F.coalesce(F.col("_us") - F.col("_chain"), F.lit(0)))
    rows = written(rows.filter(F.col("_moment") & ((F.col("_since") == 0) | (F.col("_since") >= gap))).select(*order, "_chain", "_since"))
    key = [*COOLDOWN_KEYS, "_chain"]
    later = rows.filter("_since > 0")
    kept = greedy_spacing(later.select(*key, "_since"), key, "_since", gap, initial=0, hot_rows=hot_rows)
    return rows.filter("_since = 0").unionByName(join_null_safe(later, kept, [*key, "_since"], "left_semi")).select(*order)


def _cooled_by_joins(alerts: DataFrame, gap: int, hot_rows: int) -> DataFrame:
    """The cooldown with keys that do not fit a task: the first alert of each moment joined with the moments kept."""
    rest = [c for c in alerts.columns if c not in (*COOLDOWN_KEYS, "_us")]
    first = alerts.groupBy(*COOLDOWN_KEYS, "_us").agg(
        F.min_by(F.struct(*rest), F.struct("event_id", "stage")).alias("_first")
    )
    moments = alerts.select(*COOLDOWN_KEYS, "_us")
    kept = greedy_spacing(moments.filter("_us IS NOT NULL"), COOLDOWN_KEYS, "_us", gap, hot_rows=hot_rows)
    kept = kept.unionByName(moments.filter("_us IS NULL").distinct())
    return join_null_safe(first, kept, [*COOLDOWN_KEYS, "_us"]).select(*COOLDOWN_KEYS, "_first.*")


# ---- Evidence ----

def numbered_events(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(kind, key, number, event_id, _us): the events of each proving kind, numbered per actor or host."""
    trace = traced(events).filter("fail OR auth OR logon")
    order = ["_us", "event_id"]
    per_actor = running_totals(
        trace.select("actor", "event_id", "_us", "fail", "auth", "logon"), ["actor"], order,
        {k: F.when(F.col(f), 1) for k, f in (("_fail", "fail"), ("_auth", "auth"), ("_logon", "logon"))},
        hot_rows=hot_rows,
    )
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("fail", "auth", "logon")])
    number = F
    for k in ("fail", "auth", "logon"):
        number = number.when(F.col("kind") == k, F.col(f"_{k}"))
    by_actor = per_actor.withColumn("kind", F.explode(kinds)).filter("kind IS NOT NULL").select(
        "kind", F.col("actor").alias("key"), number.alias("number"), "event_id", "_us"
    )
    by_host = running_totals(
        trace.filter("auth").select("source", "event_id", "_us"), ["source"], order, {"number": F.lit(1)},
        hot_rows=hot_rows,
    ).select(F.lit("host_auth").alias("kind"), F.col("source").alias("key"), "number", "event_id", "_us")
    return by_actor.unionByName(by_host)


def alert_evidence(alerts: DataFrame, events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(alert_id, event_ids, span_seconds) of alerts that are proved by earlier events."""
    pr = F.col("proof")
    last = pr["upto"] - F.least(pr["take"].cast("long"), pr["n"]) + 1
    first = pr["upto"] - pr["n"] + 1
    wanted = alerts.filter("proof.upto IS NOT NULL").select(
        "alert_id", micros(F.col("timestamp")).alias("_at"), pr["kind"].alias("kind"),
        F.when(pr["kind"] == "host_auth", F.col("source_host")).otherwise(F.col("actor")).alias("key"),
        last.alias("_last"),
        F.explode(F.array_distinct(F.concat(F.array(first), F.sequence(last, pr["upto"])))).alias("number"),
    )
    found = join_null_safe(wanted, numbered_events(events, hot_rows), ["kind", "key", "number"])
    # At most take + 1 rows meet in one group.
    return found.groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("number") >= F.col("_last"), F.struct("number", "event_id"))))
        .alias("_ids"),
        F.call_function("div", F.max("_at") - F.min("_us"), F.lit(SECOND)).alias("span_seconds"),
    ).select("alert_id", F.col("_ids.event_id").alias("event_ids"), "span_seconds")


def alert_hosts(alerts: DataFrame, stays: DataFrame, window_s: int) -> DataFrame:
    """(alert_id, host): every host present in the window of an alert, one row each.

    Stays are cut into window-wide slices, so alert and host meet on (actor, slice) instead of on the actor alone.
    """
    width = F.lit(window_s * SECOND)
    sliced = stays.withColumn(
        "_slice",
        F.explode(F.sequence(F.call_function("div", F.col("_start"), width), F.call_function("div", F.col("_end"), width))),
    )
    at = alerts.select("alert_id", "actor", micros(F.col("timestamp")).alias("_at"))
    at = at.withColumn("_slice", F.call_function("div", F.col("_at"), width))
    return (
        at.join(sliced, ["actor", "_slice"]).filter("_start <= _at AND _at < _end")
        .select("alert_id", F.col("source").alias("host")).distinct()
    )


def recent_hosts(
    alerts: DataFrame, events: DataFrame, window_s: int, last: int = 100, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(alert_id, host) of entity lateral alerts: hosts among the ``last`` events of the actor that lie in the window.

    The alert's own event gives its number; the events are fetched by number, at most ``last`` per alert.
    """
    rows = events.filter("actor != 'unknown'").select("actor", "source", "event_id", micros(F.col("timestamp")).alias("_us"))
    rows = running_totals(rows, ["actor"], ["_us", "event_id"], {"_number": F.lit(1)}, hot_rows=hot_rows)
    at = alerts.select("alert_id", "actor", "event_id", micros(F.col("timestamp")).alias("_us"))
    at = at.join(rows.select("actor", "event_id", "_us", "_number"), ["actor", "event_id", "_us"])
    first = F.greatest(F.lit(1).cast("long"), F.col("_number") - last + 1)
    wanted = at.select("alert_id", "actor", F.col("_us").alias("_at"), F.explode(F.sequence(first, "_number")).alias("_number"))
    met = wanted.join(rows.select("actor", "source", "_us", "_number"), ["actor", "_number"])
    return met.filter(F.col("_us") >= F.col("_at") - window_s * SECOND).select("alert_id", F.col("source").alias("host")).distinct()


def known_sources(
    alerts: DataFrame, events: DataFrame, window_s: int, keep: int = 10, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """(alert_id, known_sources): the first ``keep`` other sources by name of the actor in the window of a new-source alert.

    Time is cut into slices of window width. In the alert's own slice a source counts from the moment it is seen, in the slice
    before up to the moment it is last seen. A source of which ``keep`` + 1 smaller names count whenever it counts can
    never be among the first, so those are dropped (``_pruned``); about keep * log(sources) per (actor, slice) are left to be
    joined. Only slices that an alert looks at are read; events and alerts without a time are in no window.
    """
    width = F.lit(window_s * SECOND)
    at = alerts.select("alert_id", "actor", "source_host", micros(F.col("timestamp")).alias("_when"))
    at = at.filter("_when IS NOT NULL").withColumn("_slice", F.call_function("div", F.col("_when"), width))
    looked_at = at.select("actor", F.explode(F.array(F.col("_slice"), F.col("_slice") - 1)).alias("_slice")).distinct()
    seen = traced(events).filter("source != 'unknown' AND _us IS NOT NULL").withColumn(
        "_slice", F.call_function("div", F.col("_us"), width)
    )
    seen = join_null_safe(seen.select("actor", "source", "_slice", "_us"), looked_at, ["actor", "_slice"], "left_semi")
    seen = reliable(seen.groupBy("actor", "source", "_slice").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last")))
    # With ``keep`` + 1 sources or fewer, nothing can be dropped.
    many = reliable(seen.groupBy("actor", "_slice").agg(F.count("*").alias("_n")).filter(F.col("_n") > keep + 1).drop("_n"))
    few = seen if many.isEmpty() else join_null_safe(seen, many, ["actor", "_slice"], "left_anti")

    def pruned(at: str, sign: int) -> DataFrame:
        rows = few.withColumn("_at", F.col(at)).select("actor", "source", "_slice", "_at")
        if few is seen:
            return rows
        wide = join_null_safe(seen, many, ["actor", "_slice"], "left_semi").withColumn("_at", F.col(at))
        return rows.unionByName(_pruned(wide, sign, keep, piece_rows))

    early = pruned("_first", 1).select(
        "actor", "_slice", "source", F.col("_at").alias("_first"), F.lit(None).cast("long").alias("_last"))
    late = pruned("_last", -1).select(
        "actor", (F.col("_slice") + 1).alias("_slice"), "source", F.lit(None).cast("long").alias("_first"), F.col("_at").alias("_last"))
    met = join_null_safe(at, early.unionByName(late), ["actor", "_slice"]).filter(
        (F.col("source") != F.col("source_host"))
        & ((F.col("_first") <= F.col("_when")) | (F.col("_last") >= F.col("_when") - width))
    )
    return first_names(met.select("alert_id", F.col("source").alias("name")), "known_sources", keep)


def _pruned(seen: DataFrame, sign: int, keep: int, piece_rows: int) -> DataFrame:
    """(actor, source, _slice, _at) of ``seen`` without sources that ``keep`` + 1 smaller names of their (actor, slice) precede.

    A source precedes another if its ``sign`` * _at is not larger. An (actor, slice) of more than ``piece_rows`` rows is cut by a hash
    of the source into pieces of about that size, each of which keeps its own candidates; what is left is cut and pruned
    again until it fits one piece, or until a round drops less than half of the rows of the wide slices.
    """
    key = ["actor", "_slice"]
    rows = seen.select("actor", "source", "_slice", "_at")
    before = None
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > piece_rows)
        # At most one row per piece_rows rows.
        wide = reliable(sizes.select(*key, F.ceil(F.col("_rows") / piece_rows).alias("_pieces"), "_rows"))
        left = wide.agg(F.sum("_rows")).first()[0]
        if left is None:
            return _candidates(rows.withColumn("_piece", F.lit(0).cast("long")), sign, keep)
        if before is not None and 2 * left > before:
            return rows
        salt = F.coalesce(F.pmod(F.xxhash64("source"), F.col("_pieces")), F.lit(0).cast("long"))
        cut = join_null_safe(rows, wide.drop("_rows"), key, "left").withColumn("_piece", salt).drop("_pieces")
        rows, before = reliable(_candidates(cut, sign, keep)), left


def _candidates(cut: DataFrame, sign: int, keep: int) -> DataFrame:
    """What is left of each (actor, slice, piece) when sources that ``keep`` + 1 smaller names of the piece precede are dropped."""

    def run(table: pa.Table) -> pa.Table:
        rank = pc.rank(table["source"], "ascending", tiebreaker="first").to_numpy().astype(np.int64)
        order = np.lexsort((rank, sign * table["_at"].to_numpy()))
        smallest = rank[order]
        # The k-th smallest name so far: what the (k-1)-th passes on is the larger of the newcomer and the one it displaces.
        for _ in range(keep):
            smallest = np.maximum(smallest, np.r_[_NO_NAME, np.minimum.accumulate(smallest)[:-1]])
        bound = np.r_[_NO_NAME, np.minimum.accumulate(smallest)[:-1]]
        kept = order[rank[order] < bound]
        return table.select(["actor", "source", "_slice", "_at"]).take(pa.array(kept))

    return cut.groupBy("actor", "_slice", "_piece").applyInArrow(run, "actor string, source string, _slice bigint, _at bigint")


def first_names(names: DataFrame, column: str, keep: int) -> DataFrame:
    """(alert_id, column): the first ``keep`` distinct names of each alert; no more are gathered."""
    rank = F.row_number().over(Window.partitionBy("alert_id").orderBy("name"))
    few = names.distinct().withColumn("_n", rank).filter(F.col("_n") <= keep)
    return few.groupBy("alert_id").agg(F.array_sort(F.collect_list("name")).alias(column))


def unique_events(events: DataFrame) -> DataFrame:
    """Events with one row per event_id: the earliest, ties by payload. Rows without an id stay.

    Ids are counted first, without the events; only repeated ones are shuffled. Where most rows have a repeated id, all
    go through one shuffle, as leaving out the others would shuffle every row twice more.
    """
    counts = events.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("_n"))
    size = counts.agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("repeated")).first()
    if not size["repeated"]:
        return events
    rest = [c for c in events.columns if c != "event_id"]
    lead = [c for c in ("timestamp", "raw_payload") if c in rest]
    row = F.struct(*lead, *[c for c in rest if c not in lead])

    def earliest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_id").agg(F.min(row).alias("_e")).select("event_id", "_e.*").select(*events.columns)

    if 2 * size["repeated"] > size["rows"]:
        return earliest(events.filter("event_id IS NOT NULL")).unionByName(events.filter("event_id IS NULL"))
    again = reliable(counts.filter("_n > 1").select("event_id"))
    best = earliest(events.join(again, "event_id", "left_semi"))
    return events.join(again, "event_id", "left_anti").unionByName(best)


def identified(events: DataFrame) -> DataFrame:
    """Events without an id get one from their content; equal ones are numbered. The others are not shuffled."""
    columns = [c for c in events.columns if c != "event_id"]
    bare = events.filter("event_id IS NULL")
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    place = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
    named = bare.withColumn("_content", content).withColumn("event_id", F.concat_ws("-", F.lit("content"), F.left("_content", F.lit(32)), place))
    return events.filter("event_id IS NOT NULL").unionByName(named.select(*events.columns))


def alert_key(*cols: str) -> Column:
    """Null is a value of its own, so that an alert never gets the id of another."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in cols]), 256)


def finalise(
    alerts: DataFrame, events: DataFrame, window_s: int = 600, hot_rows: int = HOT_ROWS, shown_hosts: int = 100
) -> DataFrame:
    """Give each surviving alert its id, status, evidence and complete texts. Events need ids, see ``identified``.

    ``distinct_hosts`` has the first ``shown_hosts`` names, beside the exact number in the metadata (``first_hosts``);
    ``alert_hosts`` and ``recent_hosts`` give all as a table.
    """
    # Evidence is fetched under a number, which shuffles cheaper than the long text id.
    alerts = written(alerts.withColumn("alert_id", F.monotonically_increasing_id()))
    trace = traced(events)
    proofs = alert_evidence(alerts, events, hot_rows)
    lateral = alerts.filter("stage = %d" % STAGE["lateral_movement"])
    auths, hot_rows = placed(trace.filter("auth").select("actor", "source", "_us", "event_id", "auth"), "actor", hot_rows)
    rows = presence(auths, "actor", "source", window_s, F.col("auth"), hot_rows)
    hosts = first_hosts(lateral, spans(rows, "actor", "source"), shown_hosts, hot_rows)
    recent = alerts.filter("stage = %d" % STAGE["entity_lateral"])
    hosts = hosts.unionByName(recent_hosts(recent, events, window_s, hot_rows=hot_rows))
    hosts = first_names(hosts.withColumnRenamed("host", "name"), "distinct_hosts", shown_hosts)
    known = known_sources(alerts.filter("stage = %d" % STAGE["new_source_auth"]), events, window_s)

    full = alerts.join(proofs, "alert_id", "left").join(hosts, "alert_id", "left").join(known, "alert_id", "left")
    span = F.coalesce(F.col("span_seconds"), F.lit(0)).cast("string")
    shows_span = F.col("alert_type").isin("brute_force", "lateral_movement") & F.col("span_seconds").isNotNull()
    text = F.replace("description", F.lit("{span}"), span)
    text = F.replace(text, F.lit("{hosts}"), F.coalesce(F.array_join(F.slice("distinct_hosts", 1, 5), ", "), F.lit("")))
    text = F.replace(text, F.lit("{known}"), F.coalesce(F.array_join(F.slice("known_sources", 1, 3), ", "), F.lit("none")))
    extra = F.map_filter(
        F.create_map(
            F.lit("span_seconds"), F.when(shows_span, span),
            F.lit("known_sources"), F.array_join("known_sources", ","),
        ),
        lambda k, v: v.isNotNull(),
    )
    own = F.when(F.col("proof.own"), F.array("event_id")).otherwise(F.array().cast("array<string>"))
    return full.select(
        alert_key("alert_type", "actor", "source_host", "event_id").alias("alert_id"), "timestamp", "alert_type", "severity", "severity_score",
        F.when(F.col("title") == "{description}", text).otherwise(F.col("title")).alias("title"),
        text.alias("description"), "actor", "target", "source_host", "event_id",
        F.concat(F.coalesce("event_ids", F.array().cast("array<string>")), own).alias("event_ids"),
        "sigma_rule_id", "mitre_technique", "mitre_tactic",
        F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), extra).alias("metadata"),
        "distinct_hosts", "stage", F.lit("open").alias("status"),
    )


def correlation_stats(alerts: DataFrame, events: DataFrame, window_s: int = 600) -> DataFrame:
    """Rules, alerts, window length and actors seen in the last window, as one row."""
    newest = events.agg(F.max("timestamp")).scalar()
    active = events.filter(F.col("timestamp") >= newest - F.make_interval(secs=F.lit(window_s)))
    counts = alerts.agg(F.count("*").alias("alerts_total")).unionByName(
        active.agg(F.countDistinct("actor").alias("buffer_actors")), allowMissingColumns=True
    ).agg(F.max("alerts_total").alias("alerts_total"), F.max("buffer_actors").alias("buffer_actors"))
    return counts.select(
        F.lit(8 + len(_CUSTOM)).cast("long").alias("rules_count"), "alerts_total",
        F.lit(window_s).cast("long").alias("window_seconds"), "buffer_actors",
    )
