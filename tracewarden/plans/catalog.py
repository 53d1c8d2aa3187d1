"""Registered queries: every operator over the whole test tables, with independent SQL where SQL can say it.

The test events are sparse (about two per actor and day), so windows are one day and thresholds low here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions import fixed, predicates as p, text, times
from tracewarden.operators import cases, correlate, entities, narrative, normalize, reports, rule_versions, search, sigma, validate
from tracewarden.operators.rollup import Rollup
from tracewarden.operators.rule_index import indexed_matches
from tracewarden.plans import detection
from tracewarden.plans.adapter import load, load_events
from tracewarden.plans.oracles import NARRATIVE_ROWS, SIGMA, entity_type, risk_label, with_ctes
from tracewarden.schema import EVENT
from tracewarden.session import reliable, scratch_folder
from tracewarden.sources import arrivals, files, tables
from tracewarden.streaming.entities import LiveEntities

W = 86_400
AS_OF = "2024-01-31 00:00:00"
STALE_DAYS = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: timestamps without zone, lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query over (spark, folder); ``sql`` is its oracle."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def events_query(name: str, sql: str | None = None):
    """Register a query over the universal events."""

    def add(fn):
        query(name, sql)(lambda spark, folder: fn(load_events(spark, folder)))
        return fn

    return add


# ---- Search ----

EV = "event_id, timestamp, platform, source, actor, target, event_type, severity, raw_event_id, description, raw_payload"
EV_LIST = EV.split(", ")


@events_query("event_search", with_ctes(
    f"""SELECT {EV} FROM u WHERE platform='windows' AND source ILIKE '%HOST-1%' AND severity >= 5
    AND timestamp >= '2024-01-03' AND timestamp <= '2024-01-28 12:00:00'
    AND (description ILIKE '%log%' OR actor ILIKE '%log%' OR raw_payload ILIKE '%log%')
    ORDER BY timestamp DESC, event_id LIMIT 100 OFFSET 20""", "u"))
def _(ev):
    return search.search_events(
        ev, 100, 20, platform="windows", source="HOST-1", severity_min=5, since="2024-01-03",
        until="2024-01-28 12:00:00", search="log").select(*EV_LIST)


@events_query("event_search_info", with_ctes(
    """SELECT count(*) AS total, CAST(100 AS BIGINT) AS "limit", CAST(20 AS BIGINT) AS "offset", count(*) > 120 AS has_more
    FROM u WHERE event_type='auth' AND actor ILIKE '%user_1%'""", "u"))
def _(ev):
    return search.page_info(search.match_events(ev, event_type="auth", actor="user_1"), 100, 20)


@events_query("event_window_scan", with_ctes(
    f"SELECT {EV} FROM u WHERE timestamp BETWEEN '2024-01-10' AND '2024-01-20' AND source='host-3'", "u"))
def _(ev):
    return search.window_scan(ev, "2024-01-10", "2024-01-20", source="host-3").select(*EV_LIST)


@events_query("event_live_search", with_ctes(
    f"""SELECT {EV} FROM (SELECT * FROM u ORDER BY timestamp DESC, event_id DESC LIMIT 50000)
    WHERE severity >= 6 AND contains(lower(actor), 'user-1') AND timestamp >= '2024-01-02'
    AND contains(lower(concat_ws(' ', source, actor, description, raw_payload)), 'host-1 user')
    ORDER BY timestamp DESC, event_id DESC LIMIT 500""", "u"))
def _(ev):
    return search.live_search(ev, 500, severity_min=6, actor="USER-1", since="2024-01-02", search="Host-1 user").select(*EV_LIST)


@events_query("event_recent", with_ctes(f"SELECT {EV} FROM u ORDER BY timestamp DESC, event_id DESC LIMIT 100", "u"))
def _(ev):
    return search.recent(ev, 100).select(*EV_LIST)


@events_query("event_by_id", with_ctes(f"SELECT {EV} FROM u WHERE event_id = '77'", "u"))
def _(ev):
    return search.by_id(ev, "event_id", "77").select(*EV_LIST)


@events_query("entity_events", with_ctes(
    f"SELECT {EV} FROM u WHERE actor ILIKE '%svc_1%' ORDER BY timestamp DESC, event_id LIMIT 100", "u"))
def _(ev):
    return search.entity_events(ev, "svc_1").select(*EV_LIST)


@events_query("event_predicates", with_ctes(
    """SELECT event_id, platform='windows' AS windows, severity >= 5 AS severe, severity >= 7 AS high,
    contains(lower(actor), 'user-1') AS by_actor, contains(lower(source), 't-1') AS by_source, event_type='auth' AS auth,
    raw_event_id IN (1102,7045,4697,4720,4728,4732,4698) OR severity >= 9 AS critical,
    platform='linux' AND severity >= 5 AS subscribed FROM u""", "u"))
def _(ev):
    return ev.select(
        "event_id", p.windows_events().alias("windows"), p.min_severity(5).alias("severe"), p.high_severity().alias("high"),
        p.actor_contains("USER-1").alias("by_actor"), p.source_contains("T-1").alias("by_source"),
        p.auth_events().alias("auth"), p.critical_events().alias("critical"), p.subscription("linux", 5).alias("subscribed"))


@query("document_search",
       """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND text ILIKE '%ation%'""")
def _(spark, folder):
    docs = load(spark, folder, "documents")
    return docs.filter((F.col("lang") == "en") & F.lower("text").contains("the") & F.col("text").ilike("%ation%")).select("doc_id", "lang")


# ---- Reports ----

@events_query("count_by_platform", with_ctes("SELECT platform, count(*) AS count FROM u GROUP BY 1", "u"))
def _(ev):
    return reports.count_by(ev, "platform")


@events_query("count_by_event_type", with_ctes("SELECT event_type, count(*) AS count FROM u GROUP BY 1", "u"))
def _(ev):
    return reports.count_by(ev, "event_type")


_LEVEL = ("CASE WHEN severity >= 9 THEN 'CRITICAL' WHEN severity >= 7 THEN 'HIGH' WHEN severity >= 5 THEN 'MEDIUM' "
          "WHEN severity >= 3 THEN 'LOW' ELSE 'INFO' END")


@events_query("severity_histogram", with_ctes(f"SELECT {_LEVEL} AS level, count(*) AS count FROM u GROUP BY 1", "u"))
def _(ev):
    return reports.severity_histogram(ev)


@events_query("top_actors", with_ctes(
    "SELECT actor, count(*) AS event_count FROM u WHERE actor <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "u"))
def _(ev):
    return reports.top_by(ev, "actor")


@events_query("top_sources", with_ctes(
    "SELECT source, count(*) AS event_count FROM u WHERE source <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "u"))
def _(ev):
    return reports.top_by(ev, "source")


for _unit, _name in (("minute", "timeline_minute"), ("day", "timeline_day"), ("hour", "timeline_hour")):

    @events_query(_name, with_ctes(
        f"""SELECT date_trunc('{_unit}', timestamp)::TIMESTAMP AS bucket, count(*) AS count, max(severity) AS max_severity FROM u
        WHERE timestamp >= '2024-01-05' AND timestamp <= '2024-01-25' AND platform='windows' GROUP BY 1""", "u"))
    def _(ev, unit=_unit):
        return reports.timeline(ev, AS_OF, unit, "2024-01-05", "2024-01-25", "windows")


@events_query("event_dashboard", with_ctes(
    f"""SELECT 'total_events' AS measure, '' AS name, count(*) AS count FROM u
    UNION ALL SELECT 'events_last_hour', '', count(*) FILTER (timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) FROM u
    UNION ALL SELECT 'platform', platform, count(*) FROM u GROUP BY 2
    UNION ALL SELECT 'event_type', event_type, count(*) FROM u GROUP BY 2
    UNION ALL SELECT 'level', {_LEVEL}, count(*) FROM u GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'top_source', source, count(*) FROM u GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'top_actor', actor, count(*) FROM u GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""", "u"))
def _(ev):
    return reports.dashboard(ev, AS_OF)


# ---- Window rules ----

_RULE_COLUMNS = ["alert_type", "severity", "severity_score", "title", "actor", "source_host", "timestamp", "event_id",
                 "mitre_technique", "mitre_tactic"]
_RULE_SQL = ", ".join(_RULE_COLUMNS)


def _rule_query(name: str, alert_type: str, number: str | None, sql_number: str | None, fn) -> None:
    extra = f", {sql_number} AS n" if sql_number else ""
    body = (f"SELECT {_RULE_SQL}{extra} FROM corr " + (
        "JOIN (SELECT event_id AS e, actor AS a, n_fail, n_logon, n_src, len(hosts) AS n_hosts FROM w) x "
        "ON x.e = corr.event_id AND x.a = corr.actor " if extra else "") + f"WHERE alert_type = '{alert_type}'")

    def run(ev):
        extra_col = [F.element_at("metadata", number).cast("long").alias("n")] if number else []
        return fn(ev).select(*_RULE_COLUMNS, *extra_col)

    events_query(name, with_ctes(body, "corr"))(run)


_rule_query("brute_force", "brute_force", "failure_count", "n_fail", lambda ev: correlate.brute_force(ev, W, 3))
_rule_query("credential_stuffing", "credential_stuffing", "failure_count", "n_fail",
            lambda ev: correlate.credential_stuffing(ev, W, 2))
_rule_query("lateral_movement", "lateral_movement", "host_count", "n_hosts", lambda ev: correlate.lateral_movement(ev, W, 2))
_rule_query("escalation_chain", "privilege_escalation_chain", "login_count", "n_logon",
            lambda ev: correlate.escalation_chain(ev, W))
_rule_query("persistence_after_auth", "persistence_after_auth", "recent_auth_count", "n_src",
            lambda ev: correlate.persistence_after_auth(ev, W))
_rule_query("audit_log_cleared", "audit_log_cleared", None, None, correlate.audit_log_cleared)
_rule_query("after_hours_auth", "after_hours_auth", None, None, lambda ev: correlate.after_hours_auth(ev, W))
_rule_query("new_source_auth", "new_source_auth", None, None, lambda ev: correlate.new_source_auth(ev, W))


@events_query("correlate", with_ctes(f"SELECT stage, {_RULE_SQL} FROM corr", "corr"))
def _(ev):
    return correlate.correlate(ev, W, 3, 2, 2).select("stage", *_RULE_COLUMNS)


@events_query("global_window", with_ctes(
    """SELECT time_bucket(INTERVAL 600 SECONDS, timestamp, TIMESTAMP '1970-01-01') AS start, count(*) AS events,
    max(severity) AS max_severity, count(DISTINCT actor) AS actors, count(DISTINCT source) AS sources
    FROM u WHERE event_type='auth' GROUP BY 1""", "u"))
def _(ev):
    return correlate.global_window(ev, 600, "auth").drop("end")


@events_query("correlation_stats", with_ctes(
    """SELECT CAST(8 AS BIGINT) AS rules_count, (SELECT count(*) FROM corr) AS alerts_total, CAST(86400 AS BIGINT) AS window_seconds,
    (SELECT count(DISTINCT actor) FROM u WHERE timestamp >= (SELECT max(timestamp) FROM u) - INTERVAL 86400 SECONDS) AS buffer_actors""",
    "corr"))
def _(ev):
    return correlate.correlation_stats(correlate.correlate(ev, W, 3, 2, 2), ev, W)


_KEPT = "alert_type, stage, actor, source_host, timestamp, event_id"


@events_query("alert_cooldown", with_ctes(f"SELECT {_KEPT} FROM kept", "kept"))
def _(ev):
    ev, hot_rows = detection.prepared(ev)
    found = detection.candidates(ev, window_s=W, hosts=2, entity=_ENTITY, hot_rows=hot_rows, brute_force_threshold=3, stuffing_threshold=2)
    return correlate.cooldown(found, 7200, hot_rows).select(*_KEPT.split(", "))


_ENTITY = {"failure_threshold": 2, "stale_days": STALE_DAYS}
_OPTIONS = {"window_s": W, "hosts": 2, "cooldown_s": 7200, "brute_force_threshold": 3, "stuffing_threshold": 2, "entity": _ENTITY}


@events_query("detect_alerts", with_ctes(
    f"""SELECT {_KEPT}, severity, severity_score, title, description, array_to_string(event_ids, ',') AS event_ids,
    mitre_technique, mitre_tactic, 'open' AS status FROM kept""", "kept"))
def _(ev):
    return detection.detect(ev, **_OPTIONS).select(
        *_KEPT.split(", "), "severity", "severity_score", "title", "description", "event_ids", "mitre_technique",
        "mitre_tactic", "status")


@events_query("detect_copies", with_ctes(f"SELECT {_KEPT}, description, array_to_string(event_ids, ',') AS event_ids FROM kept", "kept"))
def _(ev):
    # Every event arrives again, and every third a third time a minute late: the first arrival in event time counts.
    late = ev.filter("raw_event_id % 3 = 0").withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    return detection.detect(ev.unionByName(ev).unionByName(late), **_OPTIONS).select(*_KEPT.split(", "), "description", "event_ids")


@events_query("investigate_alerts", with_ctes(
    f"""SELECT alert_type, stage, actor, source_host, timestamp, event_id,
    CASE WHEN regexp_matches(actor, '[0-9]') AND contains(actor, '.') THEN concat('Ip Address: ', actor) ELSE concat('User Account: ', actor) END AS who,
    hour(timestamp) >= 18 OR hour(timestamp) < 7 AS is_after_hours,
    concat(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ' UTC') AS at,
    CASE WHEN s < 60 THEN concat(s, ' seconds ago') WHEN s < 3600 THEN concat(s // 60, ' minutes ago') WHEN s < 86400 THEN concat(s // 3600, ' hours ago')
      ELSE concat(s // 86400, ' days ago') END AS relative,
    CASE WHEN mitre_technique = '' THEN NULL ELSE concat('https://attack.mitre.org/techniques/', replace(mitre_technique, '.', '/'), '/') END AS url
    FROM (SELECT *, epoch_us(TIMESTAMP '{AS_OF}' - timestamp) // 1000000 AS s FROM kept)""", "kept"))
def _(ev):
    fields = {"who": "who.summary", "is_after_hours": "when.is_after_hours", "at": "when.utc_formatted",
              "relative": "when.relative", "url": "why.mitre_url"}
    return detection.investigate(ev, AS_OF, fields, **_OPTIONS).select(*_KEPT.split(", "), *fields)


# ---- Rule packs ----

@events_query("sigma_builtin", with_ctes(
    f"SELECT sigma_rule_id, stage, description, {_RULE_SQL} FROM sig", "sig"))
def _(ev):
    return sigma.sigma_match(ev, sigma.RulePack.builtin()).select("sigma_rule_id", "stage", "description", *_RULE_COLUMNS)


# Modifiers, lists, wildcards, null, quantifiers and nesting, over the adapter events: (id, YAML body, WHERE).
_CUSTOM_RULES = [
    ("contains", "sel: {Description|contains: [LOGON, 'task']}\n  condition: sel", "lower(description) LIKE '%logon%' OR lower(description) LIKE '%task%'"),
    ("all", "sel: {Description|contains|all: [user, group]}\n  condition: sel", "lower(description) LIKE '%user%' AND lower(description) LIKE '%group%'"),
    ("starts", "sel: {SubjectUserName|startswith: SVC_, EventID: [4624, 4625]}\n  condition: sel", "actor LIKE 'svc\\_%' ESCAPE '\\' AND raw_event_id IN (4624,4625)"),
    ("ends", "sel: {Computer|endswith: '-7'}\n  condition: sel", "ends_with(source, '-7')"),
    ("wildcard", "sel: {Computer: 'HOST-1?', TargetUserName: 'user-*5'}\n  condition: sel", "regexp_full_match(source, 'host-1.') AND regexp_full_match(actor, 'user-.*5')"),
    ("regex", "sel: {Computer|re: 'host-(2|4)$'}\n  condition: sel", "regexp_matches(source, 'host-(2|4)$')"),
    ("cidr", "sel: {IpAddress|cidr: 10.0.0.8/29}\n  condition: sel", "starts_with(actor, '10.0.0.') AND TRY_CAST(split_part(actor, '.', 4) AS INT) BETWEEN 8 AND 15"),
    ("absent", "sel: {NoSuchField: null, EventID: 1102}\n  condition: sel", "raw_event_id = 1102"),
    ("payload", "sel: {'\"k\"': '1*'}\n  condition: sel", "starts_with(json_extract_string(raw_payload, '$.k'), '1')"),
    ("not", "sel: {EventID: 4625}\n  skip_a: {Computer: host-1}\n  skip_b: {Computer: host-2}\n  condition: sel and not 1 of skip_*",
     "raw_event_id=4625 AND source NOT IN ('host-1','host-2')"),
    ("two_of", "a: {EventID: 4732}\n  b: {Computer: host-4}\n  c: {Platform: windows}\n  condition: 2 of them",
     "(raw_event_id=4732)::INT + (source='host-4')::INT + (platform='windows')::INT >= 2"),
    ("all_of", "x1: {EventID: 4732}\n  x2: {Platform: windows}\n  condition: all of x*", "raw_event_id=4732 AND platform='windows'"),
    ("nested", "a: {EventID: 4720}\n  b: {Severity: 10}\n  c: {Computer: [host-1, host-3]}\n  condition: (a or b) and not (c or missing)",
     "(raw_event_id=4720 OR severity=10) AND source NOT IN ('host-1','host-3')"),
    ("list_of_blocks", "sel:\n    - {EventID: 7045}\n    - {Computer: host-9, Severity: 6}\n  condition: sel",
     "raw_event_id=7045 OR (source='host-9' AND severity=6)"),
    ("keywords", "keywords: ['\"k\": 9', '\"k\": 3']\n  condition: keywords", "contains(raw_payload, '\"k\": 9') OR contains(raw_payload, '\"k\": 3')"),
]


def _custom_pack() -> sigma.RulePack:
    pack = sigma.RulePack()
    for rule_id, body, _ in _CUSTOM_RULES:
        pack = pack.with_rule(f"id: {rule_id}\ntitle: {rule_id}\ndetection:\n  {body}\n")
    return pack


@events_query("sigma_modifiers", with_ctes(" UNION ALL ".join(
    f"SELECT '{i}' AS sigma_rule_id, event_id FROM u WHERE {where}" for i, _, where in _CUSTOM_RULES), "u"))
def _(ev):
    return sigma.sigma_match(ev, _custom_pack()).select("sigma_rule_id", "event_id")


@events_query("sigma_test_rule", with_ctes(
    "SELECT event_id, timestamp, platform='windows' AND raw_event_id IN (4624,4625) AND NOT starts_with(actor, 'svc_') AS matched FROM u", "u"))
def _(ev):
    return sigma.test_rule(ev, """
title: Logon by a person
logsource: {product: windows, service: security}
detection: {sel: {EventID: [4624, 4625]}, skip: {SubjectUserName|startswith: svc_}, condition: sel and not skip}
""")


@events_query("sigma_rule_stats", with_ctes(
    "SELECT r.id AS rule_id, count(s.event_id) AS match_count, max(s.timestamp) AS last_matched FROM (VALUES "
    + ", ".join(f"('{r[1]}')" for r in SIGMA) + ") r(id) LEFT JOIN sig s ON s.sigma_rule_id = r.id GROUP BY 1", "sig"))
def _(ev):
    pack = sigma.RulePack.builtin()
    return sigma.rule_stats(sigma.sigma_match(ev, pack), pack).select("rule_id", "match_count", "last_matched")


@events_query("sigma_summary", with_ctes(
    """SELECT 'total_rules' AS measure, '' AS name, CAST(10 AS BIGINT) AS count, CAST(NULL AS TIMESTAMP) AS last_matched
    UNION ALL SELECT 'load_errors', '', 0, NULL
    UNION ALL SELECT 'level', l, n, NULL FROM (VALUES ('critical', 1), ('high', 3), ('medium', 4), ('low', 2)) v(l, n)
    UNION ALL SELECT * FROM (SELECT 'top_matched', sigma_rule_id, count(*), max(timestamp) FROM sig GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
    "sig"))
def _(ev):
    pack = sigma.RulePack.builtin()
    return sigma.rule_summary(sigma.sigma_match(ev, pack), pack)


# Rules on free text: the payload is a whole document.
@query("sigma_documents", """
SELECT 'words' AS sigma_rule_id, CAST(doc_id AS VARCHAR) AS event_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')
UNION ALL SELECT 'mail', CAST(doc_id AS VARCHAR) FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\\.(com|org)', 'i')
UNION ALL SELECT 'german', CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de' AND contains(lower(text), ' und ')""")
def _(spark, folder):
    docs = load(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit(AS_OF).cast("timestamp").alias("timestamp"),
        F.lit("file").alias("platform"), "source", F.col("lang").alias("actor"), F.lit("unknown").alias("target"),
        F.lit("file").alias("event_type"), F.lit(1).alias("severity"), F.lit(0).alias("raw_event_id"),
        F.lit("").alias("description"), F.lit("").alias("mitre_technique"), F.lit("").alias("mitre_tactic"),
        F.col("text").alias("raw_payload"))
    pack = sigma.RulePack()
    for rule_id, body in (
        ("words", "keywords: [license, password]\n  condition: keywords"),
        ("mail", "sel: {Message|re: '[a-z0-9.]+@[a-z0-9]+\\.(com|org)'}\n  condition: sel"),
        ("german", "sel: {SubjectUserName: DE, Message|contains: ' und '}\n  condition: sel"),
    ):
        pack = pack.with_rule(f"id: {rule_id}\ntitle: {rule_id}\ndetection:\n  {body}\n")
    return sigma.sigma_match(docs, pack).select("sigma_rule_id", "event_id")


# ---- Entities ----

def _seen(ev):
    return entities.observations(ev, stale_days=STALE_DAYS)


def _snapshot(ev):
    return entities.entity_snapshot(ev, W, 2, 2, stale_days=STALE_DAYS)


@query("entity_classify", f"""SELECT id, {entity_type('id')} AS entity_type FROM (
 SELECT c_name AS id FROM customer UNION ALL SELECT concat(p_name, '$') FROM part UNION ALL SELECT concat('h', c_custkey, '.lan') FROM customer
 UNION ALL SELECT concat('bob@10.1.', c_custkey % 250, '.7') FROM customer UNION ALL SELECT concat('fe80:', c_custkey % 10, '::1') FROM customer
 UNION ALL SELECT concat('NT authority\\x', c_custkey) FROM customer UNION ALL SELECT concat('10.9.8.', c_custkey % 250) FROM customer
 UNION ALL SELECT url FROM pages UNION ALL SELECT concat('_', n_name) FROM nation)""")
def _(spark, folder):
    cust = load(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    last = (F.col("c_custkey") % 250).cast("string")
    made = F.explode(F.array(
        F.col("c_name"), F.concat(F.lit("h"), key, F.lit(".lan")), F.concat(F.lit("bob@10.1."), last, F.lit(".7")),
        F.concat(F.lit("fe80:"), (F.col("c_custkey") % 10).cast("string"), F.lit("::1")),
        F.concat(F.lit("NT authority\\x"), key), F.concat(F.lit("10.9.8."), last)))
    ids = (
        cust.select(made.alias("id"))
        .unionByName(load(spark, folder, "part").select(F.concat("p_name", F.lit("$")).alias("id")))
        .unionByName(load(spark, folder, "pages").select(F.col("url").alias("id")))
        .unionByName(load(spark, folder, "nation").select(F.concat(F.lit("_"), "n_name").alias("id")))
    )
    return ids.select("id", text.entity_type(F.col("id")).alias("entity_type"))


@events_query("entity_observations", with_ctes(
    """SELECT event_id, actor, branch, event_number, failures, array_to_string(list_sort(flags), ',') AS flags,
    CAST(risk_own AS DOUBLE) AS risk_added FROM d""", "d"))
def _(ev):
    return _seen(ev).select("event_id", "actor", "branch", "event_number", "failures", F.array_sort("flags").alias("flags"), "risk_added")


@events_query("entity_deviations", with_ctes(
    """SELECT flag AS alert_type, actor, source AS source_host, timestamp, event_id, severity, severity_score, description FROM dev""", "dev"))
def _(ev):
    return entities.deviations(ev, 2, stale_days=STALE_DAYS).select(
        "alert_type", "actor", "source_host", "timestamp", "event_id", "severity", "severity_score", "description")


@events_query("success_after_failures", with_ctes(
    "SELECT d.actor, d.event_id, d.timestamp, runs.failures, runs.run FROM runs JOIN d ON d.event_id = runs.event_id AND d.actor = runs.actor WHERE run > 0", "runs"))
def _(ev):
    return entities.success_after_failures(_seen(ev), 2).select("actor", "event_id", "timestamp", "failures", "run")


@events_query("entity_lateral", with_ctes(
    "SELECT actor, source AS source_host, timestamp, event_id, len(hosts) AS host_count FROM lat WHERE len(hosts) >= 2", "lat"))
def _(ev):
    return entities.entity_lateral(ev, W, 2).select(
        "actor", "source_host", "timestamp", "event_id", F.element_at("metadata", "host_count").cast("long").alias("host_count"))


_RUNNING = "CAST(least(100, sum(risk_added) OVER (PARTITION BY actor ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING)) AS DOUBLE)"


@events_query("risk_scores", with_ctes(
    f"SELECT *, {risk_label('risk_score')} AS risk_label FROM (SELECT actor, event_id, timestamp, CAST(risk_added AS DOUBLE) AS risk_added, {_RUNNING} AS risk_score FROM r)", "r"))
def _(ev):
    return entities.risk_scores(ev, window_s=W, hosts=2, stale_days=STALE_DAYS)


_SNAP = ("entity_id, entity_type, first_seen, last_seen, event_count, risk_score, risk_label, last_risk_update")
_META = ["auth_failures", "auth_successes", "known_hosts", "known_host_count", "active_hours", "deviation_flags", "known_event_types"]


@events_query("entity_snapshot", with_ctes(f"SELECT {_SNAP}, {', '.join(_META)} FROM snap", "snap"))
def _(ev):
    return _snapshot(ev).select(*_SNAP.split(", "), *[f"metadata.{m}" for m in _META])


@events_query("entity_timeline", with_ctes(
    """SELECT actor AS entity_id, timestamp, event_id, event_type, target, source AS source_host, severity, description FROM d
    WHERE severity >= 6 OR len(flags) > 0 OR event_id IN (SELECT event_id FROM runs WHERE run > 0)""", "d", "runs"))
def _(ev):
    return entities.entity_timeline(ev, 6, 2, stale_days=STALE_DAYS)


@events_query("entity_timeline_of", with_ctes(
    """SELECT actor AS entity_id, timestamp, event_id, event_type, target, source AS source_host, severity, description FROM d
    WHERE actor = 'user-3' AND timestamp >= '2024-01-05' AND (severity >= 4 OR len(flags) > 0 OR event_id IN (SELECT event_id FROM runs WHERE run > 0))
    ORDER BY timestamp DESC, event_id LIMIT 200""", "d", "runs"))
def _(ev):
    # One entity depends on its own events only, so the entity filter goes first and reaches the scan.
    return search.timeline_of(entities.entity_timeline(ev.filter("actor = 'user-3'"), 4, 2, stale_days=STALE_DAYS), "user-3", "2024-01-05")


@events_query("risk_decay", with_ctes(
    f"""SELECT *, {risk_label('risk_score')} AS risk_label FROM (SELECT entity_id,
    CASE WHEN h >= 24 AND greatest(0, risk_score - 2 * h) < risk_score THEN TIMESTAMP '2024-02-03' ELSE last_risk_update END AS last_risk_update,
    round(CASE WHEN h >= 24 THEN greatest(0, risk_score - 2 * h) ELSE risk_score END, 2) AS risk_score
    FROM (SELECT *, epoch_us(TIMESTAMP '2024-02-03' - last_risk_update) / 3600000000.0 AS h FROM snap))""", "snap"))
def _(ev):
    low = entities.decay(_snapshot(ev), "2024-02-03")
    return low.select("entity_id", "last_risk_update", "risk_score", "risk_label")


@events_query("mark_stale", with_ctes(
    "SELECT entity_id, last_seen, last_seen < TIMESTAMP '2024-02-03' - INTERVAL 7 DAYS AS is_stale FROM snap", "snap"))
def _(ev):
    return entities.mark_stale(_snapshot(ev), "2024-02-03", 7).select("entity_id", "last_seen", "is_stale")


@events_query("top_risk", with_ctes(
    "SELECT entity_id, risk_score, risk_label FROM snap WHERE entity_type = 'user' ORDER BY risk_score DESC, entity_id LIMIT 20", "snap"))
def _(ev):
    return entities.top_risk(_snapshot(ev), 20, "user").select("entity_id", "risk_score", "risk_label")


@events_query("entity_stats", with_ctes(
    """SELECT 'total' AS measure, '' AS name, count(*) AS count FROM snap
    UNION ALL SELECT 'stale', '', count(*) FILTER (last_seen < TIMESTAMP '2024-02-03' - INTERVAL 7 DAYS) FROM snap
    UNION ALL SELECT 'type', entity_type, count(*) FROM snap GROUP BY 2
    UNION ALL SELECT 'risk_label', risk_label, count(*) FROM snap GROUP BY 2""", "snap"))
def _(ev):
    return entities.entity_stats(entities.mark_stale(_snapshot(ev), "2024-02-03", 7))


@events_query("entity_search", with_ctes(
    """SELECT entity_id, entity_type, risk_score, last_seen FROM snap WHERE entity_type = 'user' AND risk_score >= 20 AND entity_id ILIKE '%1%'
    ORDER BY risk_score DESC, last_seen DESC, entity_id LIMIT 50 OFFSET 5""", "snap"))
def _(ev):
    return search.search_entities(_snapshot(ev), 50, 5, type="user", risk_min=20, search="1").select(
        "entity_id", "entity_type", "risk_score", "last_seen")


@events_query("entity_find", with_ctes(
    "SELECT entity_id, risk_score FROM snap WHERE contains(lower(entity_id), 'svc') ORDER BY risk_score DESC, entity_id LIMIT 20", "snap"))
def _(ev):
    return search.find_entities(_snapshot(ev), "SVC", 20).select("entity_id", "risk_score")


@events_query("entity_by_id", with_ctes("SELECT entity_id, event_count, risk_score FROM snap WHERE entity_id = 'user-7'", "snap"))
def _(ev):
    return search.by_id(_snapshot(ev), "entity_id", "user-7").select("entity_id", "event_count", "risk_score")


# ---- Alert tables ----

def _alerts(ev) -> DataFrame:
    found = sigma.sigma_match(ev, sigma.RulePack.builtin()).unionByName(correlate.correlate(ev, W, 3, 2, 2))
    key = correlate.alert_key("alert_type", "actor", "source_host", "event_id")
    return found.withColumns({"alert_id": key, "status": F.lit("open")})


def _stored_alerts(ev) -> DataFrame:
    """The alert table written once, as a deployment has it, for queries that read it several times."""
    return reliable(_alerts(ev))


# A status log made from the alerts: one entry per alert whose event id ends in 1..4, two for those ending in 3.
_LOG_SQL = """SELECT alert_id, timestamp + INTERVAL 1 HOUR AS moment, CASE right(event_id, 1) WHEN '1' THEN 'acknowledged' WHEN '2' THEN 'resolved'
  WHEN '3' THEN 'acknowledged' ELSE 'false_positive' END AS status, 'ann' AS "by" FROM alerts WHERE right(event_id, 1) IN ('1','2','3','4')
 UNION ALL SELECT alert_id, timestamp + INTERVAL 2 HOUR, 'resolved', 'bob' FROM alerts WHERE right(event_id, 1) = '3'"""
_STATE_SQL = """SELECT a.* EXCLUDE (status), coalesce(g.status, a.status) AS status, acknowledged_by, acknowledged_at, resolved_at
 FROM alerts a LEFT JOIN (SELECT alert_id, max_by(status, moment) AS status, max_by("by", moment) FILTER (status = 'acknowledged') AS acknowledged_by,
  max(moment) FILTER (status = 'acknowledged') AS acknowledged_at, max(moment) FILTER (status = 'resolved') AS resolved_at
  FROM log GROUP BY alert_id) g ON g.alert_id = a.alert_id"""


def _status_log(alerts: DataFrame) -> DataFrame:
    last = F.right("event_id", F.lit(1))
    hour = F.expr("INTERVAL 1 HOUR")
    first = F.struct(
        (F.col("timestamp") + hour).alias("at"),
        F.when(last.isin("1", "3"), "acknowledged").when(last == "2", "resolved").otherwise("false_positive").alias("status"),
        F.lit("ann").alias("by"))
    second = F.struct((F.col("timestamp") + hour + hour).alias("at"), F.lit("resolved").alias("status"), F.lit("bob").alias("by"))
    entries = F.when(last == "3", F.array(first, second)).otherwise(F.array(first))
    return alerts.filter(last.isin("1", "2", "3", "4")).select("alert_id", F.explode(entries).alias("e")).select("alert_id", "e.*")


def _state(ev) -> DataFrame:
    alerts = _stored_alerts(ev)
    return cases.alert_state(alerts, _status_log(alerts))


_ALERT = ["alert_id", "alert_type", "severity", "severity_score", "actor", "source_host", "timestamp", "event_id", "status"]
_ALERT_SQL = ", ".join(_ALERT)


@events_query("alert_status", with_ctes(
    f"SELECT {_ALERT_SQL}, acknowledged_by, acknowledged_at, resolved_at FROM state", "alerts", log=_LOG_SQL, state=_STATE_SQL))
def _(ev):
    return _state(ev).select(*_ALERT, "acknowledged_by", "acknowledged_at", "resolved_at")


@events_query("alert_search", with_ctes(
    f"""SELECT {_ALERT_SQL} FROM alerts WHERE severity = 'HIGH' AND actor ILIKE '%USER-1%' AND alert_type = 'sigma:builtin-004' AND timestamp >= '2024-01-04'
    ORDER BY severity_score DESC, timestamp DESC, alert_id LIMIT 40 OFFSET 3""", "alerts"))
def _(ev):
    return search.search_alerts(_alerts(ev), 40, 3, severity="HIGH", actor="USER-1", alert_type="sigma:builtin-004",
                                since="2024-01-04").select(*_ALERT)


@events_query("alert_feed", with_ctes(
    f"""SELECT {_ALERT_SQL} FROM state WHERE status = 'open' AND timestamp >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOURS
    ORDER BY severity_score DESC, timestamp DESC, alert_id LIMIT 50""", "alerts", log=_LOG_SQL, state=_STATE_SQL))
def _(ev):
    return search.alert_feed(_state(ev), "2024-01-30 00:00:00").select(*_ALERT)


@events_query("alert_by_id", with_ctes(f"SELECT {_ALERT_SQL} FROM alerts WHERE event_id = '7'", "alerts"))
def _(ev):
    return search.by_id(_alerts(ev), "event_id", "7").select(*_ALERT)


@events_query("entity_alerts", with_ctes(
    f"SELECT {_ALERT_SQL} FROM alerts WHERE actor ILIKE '%user-2%' ORDER BY severity_score DESC, timestamp DESC, alert_id LIMIT 50", "alerts"))
def _(ev):
    return search.entity_alerts(_alerts(ev), "user-2").select(*_ALERT)


@events_query("alert_stats", with_ctes(
    """SELECT 'severity' AS measure, severity AS name, count(*) AS count FROM state GROUP BY 2
    UNION ALL SELECT 'status', status, count(*) FROM state GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'type', alert_type, count(*) FROM state GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
    UNION ALL SELECT 'last_24h', '', count(*) FROM state WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOURS""",
    "alerts", log=_LOG_SQL, state=_STATE_SQL))
def _(ev):
    return reports.alert_stats(_state(ev), "2024-01-30 00:00:00")


# ---- Narratives ----

# Placeholders of a narrative text, filled as the operator fills them.
_FILL = ("replace(replace(replace(replace({}, '{{actor}}', actor), '{{source_host}}', source_host), "
         "'{{source_ip}}', list_last(string_split(actor, '@'))), '{{target}}', CASE WHEN coalesce(target, '') = '' THEN 'unknown' ELSE target END)")


@events_query("narrative_sections", with_ctes(
    f"""SELECT alert_id,
    CASE WHEN regexp_matches(actor, '[0-9]') AND contains(actor, '.') THEN 'IP address' ELSE 'user account' END AS actor_type,
    concat('Host: ', source_host) AS place, hour(timestamp) AS hour,
    CASE WHEN s < 60 THEN concat(s, ' seconds ago') WHEN s < 3600 THEN concat(s // 60, ' minutes ago') WHEN s < 86400 THEN concat(s // 3600, ' hours ago')
      ELSE concat(s // 86400, ' days ago') END AS relative,
    CASE WHEN sigma_rule_id IS NOT NULL THEN concat('Rule: ', sigma_rule_id) ELSE concat('MITRE ', mitre_technique) END AS reason,
    {_FILL.format("what")} AS what, {_FILL.format("why")} AS why
    FROM (SELECT *, epoch_us(TIMESTAMP '{AS_OF}' - timestamp) // 1000000 AS s FROM alerts) a
    JOIN texts ON template = CASE WHEN starts_with(alert_type, 'sigma:') THEN 'default' ELSE alert_type END""", "alerts", texts=NARRATIVE_ROWS))
def _(ev):
    fields = {"actor_type": "who.actor_type", "place": "where.summary", "hour": "when.hour", "relative": "when.relative",
              "reason": "why.summary", "what": "what", "why": "why.explanation"}
    return narrative.five_w_fields(_alerts(ev), AS_OF, fields).select("alert_id", *fields)


@events_query("narrative_how", with_ctes(
    f"""SELECT alert_id, {_FILL.format("commands")} AS commands, {_FILL.format("steps")} AS steps, runnable AS command_count
    FROM alerts JOIN texts ON template = CASE WHEN starts_with(alert_type, 'sigma:') THEN 'default' ELSE alert_type END""",
    "alerts", texts=NARRATIVE_ROWS))
def _(ev):
    told = narrative.five_w_fields(_alerts(ev), AS_OF, {
        "commands": "how.investigation_commands", "steps": "how.remediation_steps", "command_count": "how.command_count"})
    return told.select("alert_id", F.array_join("commands", "\n").alias("commands"), F.array_join("steps", "\n").alias("steps"), "command_count")


# ---- Cases: a log made from the alerts, one case per actor ----

_CASE_SQL = """SELECT actor AS investigation_id, list_sort(list(alert_id) FILTER (stage < 20000)) AS created_with,
 list_sort(list(DISTINCT alert_id)) AS alert_ids, min(timestamp) AS created_at,
 greatest(min(timestamp), max(timestamp) FILTER (stage >= 20000), CASE WHEN count(*) >= 40 THEN max(timestamp) END) AS updated_at,
 max(timestamp) AS newest, count(*) AS n FROM alerts GROUP BY 1"""


def _case_log(alerts: DataFrame) -> DataFrame:
    """Per actor: created with its rule-pack alerts, window alerts attached, one note per attached alert, closed when big."""
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def entry(action: str, at: Column, **values: Column) -> list[Column]:
        names = ["title", "description", "severity", "assigned_to", "status", "content", "author", "note_type"]
        return [
            F.lit(action).alias("action"), at.alias("at"),
            *[values.get(n, none).alias(n) for n in names],
            values.get("alert_ids", no_list).alias("alert_ids"), values.get("event_ids", no_list).alias("event_ids"),
        ]

    actor = F.col("actor").alias("investigation_id")
    by_actor = alerts.groupBy("actor").agg(
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("stage") < 20000, F.col("alert_id")))).alias("ids"))
    window = alerts.filter("stage >= 20000")
    one = F.array("alert_id")
    return (
        by_actor.select(actor, *entry("create", F.col("t0"), title=F.concat(F.lit("Case "), "actor"), alert_ids=F.col("ids"),
                                      event_ids=F.array(F.lit("1"), F.lit("2"))))
        .unionByName(by_actor.filter("n >= 40").select(actor, *entry("status", F.col("t1"), status=F.lit("closed"))))
        .unionByName(window.select(actor, *entry("attach", F.col("timestamp"), alert_ids=one)))
        .unionByName(window.select(actor, *entry("note", F.col("timestamp"), content=F.col("alert_type"), author=F.lit("ann"),
                                                 note_type=F.lit("note"))))
    )


@events_query("cases", with_ctes(
    """SELECT investigation_id, concat('Case ', investigation_id) AS title, CASE WHEN n >= 40 THEN 'closed' ELSE 'open' END AS status,
    'MEDIUM' AS severity, created_at, updated_at, CASE WHEN n >= 40 THEN newest END AS closed_at, len(alert_ids) AS alert_count,
    array_to_string(alert_ids, ',') AS alert_ids FROM c""", "alerts", c=_CASE_SQL))
def _(ev):
    state = cases.cases(_case_log(_stored_alerts(ev)))
    return state.select("investigation_id", "title", "status", "severity", "created_at",
                        "updated_at", "closed_at", F.size("alert_ids").alias("alert_count"), "alert_ids")


@events_query("case_list", with_ctes(
    """SELECT investigation_id, created_at FROM c WHERE n < 40 ORDER BY created_at DESC, investigation_id LIMIT 50 OFFSET 2""",
    "alerts", c=_CASE_SQL))
def _(ev):
    return search.list_cases(cases.cases(_case_log(_stored_alerts(ev))), 50, 2, "open").select("investigation_id", "created_at")


@events_query("case_notes", with_ctes(
    """SELECT actor AS investigation_id, count(*) AS notes, string_agg(alert_type, ',' ORDER BY timestamp, alert_type) AS contents
    FROM alerts WHERE stage >= 20000 GROUP BY 1""", "alerts"))
def _(ev):
    return cases.case_notes(_case_log(_stored_alerts(ev))).select(
        "investigation_id", F.size("notes").cast("long").alias("notes"), F.array_join("notes.content", ",").alias("contents"))


@events_query("case_contents", with_ctes(
    """SELECT actor AS investigation_id, timestamp, 'alert' AS kind, alert_id AS id, alert_type AS about, actor FROM alerts
    UNION ALL SELECT c.investigation_id, u.timestamp, 'event', u.event_id, u.description, u.actor FROM c JOIN u ON u.event_id IN ('1', '2')""",
    "alerts", c=_CASE_SQL))
def _(ev):
    alerts = _stored_alerts(ev)
    return cases.case_contents(cases.cases(_case_log(alerts)), alerts, ev)


@events_query("system_totals", with_ctes(
    """SELECT (SELECT count(*) FROM u) AS events_total, (SELECT count(*) FROM u WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR) AS events_last_hour,
    (SELECT count(*) FROM alerts) AS alerts_total, (SELECT count(*) FROM alerts WHERE right(event_id, 1) NOT IN ('1','2','3','4')) AS alerts_open,
    (SELECT count(*) FROM snap) AS entities_total, CAST(10 AS BIGINT) AS rules_active,
    (SELECT count(*) FROM c WHERE n < 40) AS investigations_open""", "alerts", "snap", c=_CASE_SQL))
def _(ev):
    alerts = _stored_alerts(ev)
    return reports.totals(ev, cases.alert_state(alerts, _status_log(alerts)), _snapshot(ev), len(sigma.RulePack.builtin().rules),
                          cases.cases(_case_log(alerts)), "2024-01-30 00:00:00")


# ---- Streams and tables that change: the events arrive in pieces, in order of time ----

def _pieces(spark, folder, parts: int):
    """Writes the events into one folder piece by piece, in order of time, and tells the folder after each piece."""
    path, events = scratch_folder(spark), load_events(spark, folder)
    low, high = events.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    part = F.least(F.floor((F.unix_micros("timestamp") - low) * parts / (high - low + 1)), F.lit(parts - 1))
    for i in range(parts):
        events.filter(part == i).write.mode("append").parquet(path)
        yield path


def _followed(spark, folder, parts: int = 3) -> LiveEntities:
    """Live entities after a stream of all events: what is new is followed as each piece arrives, one micro-batch a piece."""
    live = LiveEntities(spark, scratch_folder(spark), W, 2, 2, min_severity=6, compact_every=2, stale_days=STALE_DAYS)
    checkpoint = scratch_folder(spark)
    for path in _pieces(spark, folder, parts):
        events = spark.readStream.schema(EVENT).parquet(path)
        live.start(events, checkpoint, availableNow=True).awaitTermination()
    return live


@query("live_snapshot", with_ctes(f"SELECT {_SNAP}, {', '.join(_META)} FROM snap", "snap"))
def _(spark, folder):
    return _followed(spark, folder).snapshot().select(*_SNAP.split(", "), *[f"metadata.{m}" for m in _META])


@query("live_risk", ORACLES["risk_scores"])
def _(spark, folder):
    return _followed(spark, folder).risk()


@query("live_timeline", ORACLES["entity_timeline"])
def _(spark, folder):
    return _followed(spark, folder).timeline()


_SINCE = "2024-01-12 12:00:00"


@query("retention_live", with_ctes(
    f"SELECT CASE WHEN timestamp < '{_SINCE}' THEN 'archive' ELSE 'live' END AS place, event_id, timestamp, actor FROM u", "u"))
def _(spark, folder):
    """Written, archived twice, the second time with a repeated run; both tables are read as they are on disk."""
    live, archive = scratch_folder(spark), scratch_folder(spark)
    tables.write_dated(load_events(spark, folder), live)
    for as_of in ("2024-04-05", "2024-04-11 12:00:00", "2024-04-11 12:00:00"):
        tables.retain_events(spark, live, archive, as_of, 90)
    both = spark.read.parquet(live).withColumn("place", F.lit("live")).unionByName(spark.read.parquet(archive).withColumn("place", F.lit("archive")))
    return both.select("place", "event_id", "timestamp", "actor")


@query("first_arrivals", with_ctes(
    """SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN timestamp - INTERVAL 2 DAYS ELSE timestamp END AS timestamp,
    CAST(CASE CAST(event_id AS BIGINT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS batch FROM u""", "u"))
def _(spark, folder):
    """Three batches and a repeated one; what comes again is older by event time and loses all the same."""
    path, events = scratch_folder(spark), load_events(spark, folder)
    third = F.col("event_id").cast("long") % 3
    earlier = events.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 2 DAYS"))
    first = earlier.filter(third == 0)
    second = events.filter(third <= 1).unionByName(events.filter(third == 1))
    for number, batch in enumerate([first, second, events.unionByName(earlier.limit(0))]):
        arrivals.append_first(batch, path, number, buckets=16)
    arrivals.append_first(earlier, path, 2, buckets=16)
    return arrivals.read_first(spark, path).select("event_id", "timestamp", "batch")


# ---- Normalisation: text built from the tables, parsed, compared with what it was built from ----

@events_query("json_events", with_ctes(f"SELECT {EV} FROM u", "u"))
def _(ev):
    valid, _ = validate.parse_event_json(validate.to_json_lines(ev), AS_OF)
    return valid.select(*EV_LIST)


_BROKEN = """CASE WHEN k % 10 = 0 THEN 'invalid json' WHEN k % 10 = 1 THEN 'missing required field: source' END"""


@query("json_rejects", f"SELECT reason, count(*) AS count FROM (SELECT {_BROKEN} AS reason FROM (SELECT CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)) WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, folder):
    _, bad = validate.parse_event_json(_damaged(spark, folder), AS_OF)
    return bad.groupBy("reason").agg(F.count("*").alias("count"))


def _damaged(spark, folder) -> DataFrame:
    """JSON lines of the events; one in ten is cut short, one in ten has no source."""
    ev = load_events(spark, folder)
    k = F.get_json_object("raw_payload", "$.k").cast("int")
    lines = ev.withColumns({"k": k, "source": F.when(k % 10 != 1, F.col("source"))})
    cut = F.expr("CASE WHEN k % 10 = 0 THEN left(value, length(value) - 5) ELSE value END")
    return lines.select("k", F.to_json(F.struct(
        "event_id", F.col("timestamp").cast("string").alias("timestamp"), "platform", "source",
        F.struct("actor", "target").alias("entity"),
        F.struct(F.col("event_type").alias("type"), "severity", "raw_event_id", "description").alias("event"),
        "raw_payload")).alias("value")).select(cut.alias("value"))


@query("ingest_counters", """SELECT count(*) AS received, count(*) FILTER (k % 10 < 2) AS rejected, count(*) FILTER (k % 10 >= 2) AS processed,
 CAST(0 AS BIGINT) AS duplicates FROM (SELECT CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)""")
def _(spark, folder):
    lines = _damaged(spark, folder)
    valid, bad = validate.parse_event_json(lines, AS_OF)
    return reports.ingest_counters(lines, bad, tables.dedup_events(valid))


@query("validate_repairs", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS event_id,
 CASE WHEN l_returnflag = 'R' THEN 'windows' ELSE 'unknown' END AS platform,
 CAST(greatest(0, least(10, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE trunc(l_quantity) - 20 END)) AS INT) AS severity,
 CASE WHEN l_linestatus = 'O' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE l_shipdate END AS timestamp,
 CASE WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'x' END AS event_type FROM lineitem""")
def _(spark, folder):
    li = load(spark, folder, "lineitem")
    quantity = F.when(F.col("l_linenumber") % 3 == 0, F.lit('"high"')).otherwise((F.col("l_quantity") - 20).cast("string"))
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.when(F.col("l_linestatus") == "O", "yesterday").otherwise(F.col("l_shipdate").cast("string")).alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "Windows").otherwise("mainframe").alias("platform"),
        F.lit("s").alias("source"), F.lit(None).cast("string").alias("entity"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("["), quantity, F.lit("]")))
        .otherwise(F.concat(F.lit('{"type":"x","severity":'), quantity, F.lit("}"))).alias("event"),
        F.lit("5").alias("mitre"), F.lit(None).cast("string").alias("raw_payload"))
    valid, _ = validate.validate(rows, AS_OF)
    return valid.select("event_id", "platform", "severity", "timestamp", "event_type")


ORACLES["validate_repairs"] = ORACLES["validate_repairs"].replace(
    "CAST(greatest(0,", "CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE greatest(0,").replace("- 20 END)) AS INT)", "- 20 END)) END AS INT)")


@query("sanitise", """SELECT CAST(doc_id AS VARCHAR) AS event_id, left(text, 4096) AS raw_payload, left(text, 256) AS source,
 left(text, 256) AS actor, left(text, 512) AS description FROM documents""")
def _(spark, folder):
    docs = load(spark, folder, "documents")
    body = F.col("text")
    rows = docs.select(F.col("doc_id").cast("string").alias("event_id"), body.alias("raw_payload"), body.alias("source"),
                       body.alias("actor"), body.alias("target"), body.alias("description"))
    return validate.sanitise_events(rows).drop("target")


_KNOWN = ", ".join(f"({n}, '{t}', {s}, '{q}', '{c}')" for n, (t, s, q, c) in fixed.WINDOWS_EVENTS.items())
_WTYPE = """CASE WHEN {n} BETWEEN 4624 AND 4634 THEN 'auth' WHEN {n} BETWEEN 4688 AND 4699 THEN 'process' WHEN {n} IN (7045, 4697, 1102) THEN 'config'
 WHEN {n} BETWEEN 5140 AND 5145 THEN 'network' WHEN {n} BETWEEN 4720 AND 4767 THEN 'config' ELSE 'system' END"""


@query("windows_types", f"SELECT o_orderkey AS event_id, {_WTYPE.replace('{n}', '(o_orderkey % 8000)')} AS event_type, (o_orderkey % 8000) IN ({', '.join(map(str, fixed.MONITORED_IDS))}) AS monitored FROM orders")
def _(spark, folder):
    n = F.col("o_orderkey") % 8000
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), normalize.windows_type(n).alias("event_type"), p.is_monitored(n).alias("monitored"))


_WIN_COLUMNS = ["timestamp", "source", "actor", "target", "event_type", "severity", "raw_event_id", "description",
                "mitre_technique", "mitre_tactic"]


def _windows_raw(spark, folder) -> DataFrame:
    """Windows records from orders: ids in rotation, some with user, address, process or service."""
    o = load(spark, folder, "orders")
    ids = F.array(*[F.lit(i) for i in [*fixed.WINDOWS_EVENTS, 4634, 4648, 9999]])
    k = F.col("o_orderkey")
    return o.select(
        F.get(ids, (k % 22).cast("int")).alias("raw_event_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("pc-"), (k % 40).cast("string")).alias("computer"), F.lit("Security").alias("channel"),
        F.concat(F.lit("adm"), (k % 3).cast("string")).alias("subject_user"),
        F.when(k % 2 == 0, F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).when(k % 4 == 1, "-").otherwise("").alias("target_user"),
        F.lit("3").alias("logon_type"),
        F.when(k % 5 == 0, F.concat(F.lit("10.1.1."), (k % 200).cast("string"))).when(k % 5 == 1, "::1").when(k % 5 == 2, "-").otherwise("").alias("ip_address"),
        F.when(k % 7 == 0, r"C:\x.exe").otherwise("").alias("process_name"),
        F.when(k % 11 == 0, "spooler").otherwise("").alias("service_name"),
        k.cast("string").alias("raw_payload"))


_WIN_SQL = f"""WITH known(id, description, severity, technique, tactic) AS (VALUES {_KNOWN}),
r AS (SELECT *, o_orderkey AS k, ([{', '.join(map(str, [*fixed.WINDOWS_EVENTS, 4634, 4648, 9999]))}])[o_orderkey % 22 + 1] AS n FROM orders)
SELECT CAST(k AS VARCHAR) AS raw_payload, o_orderdate AS timestamp, concat('pc-', k % 40) AS source,
 concat(CASE WHEN k % 2 = 0 THEN concat('user', o_custkey) ELSE concat('adm', k % 3) END, CASE WHEN k % 5 = 0 THEN concat('@10.1.1.', k % 200) ELSE '' END) AS actor,
 CASE WHEN k % 11 = 0 THEN 'spooler' WHEN k % 7 = 0 THEN 'C:\\x.exe' ELSE concat('pc-', k % 40) END AS target,
 {_WTYPE.replace('{n}', 'n')} AS event_type, coalesce(known.severity, 2) AS severity, n AS raw_event_id,
 CASE WHEN k % 11 = 0 THEN concat(coalesce(description, ''), ': spooler') ELSE coalesce(description, concat('Windows Event ID ', n)) END AS description,
 coalesce(technique, '') AS mitre_technique, coalesce(tactic, '') AS mitre_tactic FROM r LEFT JOIN known ON known.id = r.n"""


@query("windows_events", _WIN_SQL)
def _(spark, folder):
    return normalize.normalise_windows(_windows_raw(spark, folder)).select("raw_payload", *_WIN_COLUMNS)


@query("windows_xml", _WIN_SQL.replace("CAST(k AS VARCHAR) AS raw_payload, ", "k, "))
def _(spark, folder):
    raw = _windows_raw(spark, folder)
    data = F.concat(*[
        F.concat(F.lit(f'<Data Name="{name}">'), F.col(c), F.lit("</Data>"))
        for name, c in (("SubjectUserName", "subject_user"), ("TARGETUSERNAME", "target_user"), ("IpAddress", "ip_address"),
                        ("NewProcessName", "process_name"), ("ServiceName", "service_name"))])
    xml = F.concat(
        F.lit('<Objects><Object><Event xmlns="e"><System><EventID>'), F.col("raw_event_id").cast("string"),
        F.lit('</EventID><TimeCreated SystemTime="'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('.0000000Z"/><Computer>'), F.col("computer"), F.lit("</Computer><Channel>Security</Channel></System><EventData>"),
        data, F.lit("</EventData></Event></Object></Objects>"))
    lines = raw.select(F.col("raw_payload").cast("long").alias("k"), xml.alias("value"))
    return normalize.normalise_windows(files.parse_windows_xml(lines, AS_OF), keep=["k"]).select("k", *_WIN_COLUMNS)


def _linux_lines(spark, folder) -> DataFrame:
    ev = load(spark, folder, "events")
    user, ip = F.col("user_id").cast("string"), F.concat(F.lit("10.2.0."), (F.col("user_id") % 250).cast("string"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "MMM d HH:mm:ss")
    stamp = F.regexp_replace(stamp, r"^(\w{3}) (\d) ", "$1  $2 ")
    kind = F.col("event_type")
    said = (
        F.when(kind == "error", F.concat(F.lit("sshd[77]: Failed password for invalid user u"), user, F.lit(" from "), ip, F.lit(" port 22 ssh2")))
        .when(kind == "click", F.concat(F.lit("sshd[78]: Accepted publickey for u"), user, F.lit(" from "), ip, F.lit(" port 5 ssh2")))
        .when(kind == "signup", F.concat(F.lit("useradd[9]: new user: name=u"), user))
        .when(kind == "purchase", F.concat(F.lit("sudo: u"), user, F.lit(" : TTY=pts/0 ; COMMAND=/bin/ls")))
        .otherwise(F.concat(F.lit("systemd-logind[1]: session of u"), user, F.lit(" removed"))))
    return ev.select(F.concat(stamp, F.lit(" web01 "), said).alias("value"), F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("hostname"), F.col("event_id").alias("id"))


@query("linux_lines", """
SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS timestamp, concat('h', event_id % 9) AS source,
 CASE event_type WHEN 'signup' THEN 'useradd' ELSE concat('u', user_id) END AS actor,
 CASE WHEN event_type IN ('error', 'click') THEN concat('10.2.0.', user_id % 250) ELSE concat('h', event_id % 9) END AS target,
 CASE event_type WHEN 'signup' THEN 'config' WHEN 'purchase' THEN 'process' ELSE 'auth' END AS event_type,
 CASE event_type WHEN 'error' THEN 6 WHEN 'click' THEN 2 WHEN 'signup' THEN 8 ELSE 5 END AS severity,
 CASE event_type WHEN 'error' THEN 'T1110' WHEN 'click' THEN 'T1078' WHEN 'signup' THEN 'T1136' ELSE 'T1548' END AS mitre_technique
FROM events WHERE event_type <> 'view'""")
def _(spark, folder):
    lines = _linux_lines(spark, folder)
    parsed = normalize.parse_linux_lines(lines.filter(~normalize.is_noise(F.col("value"))), 2024, AS_OF)
    done = normalize.normalise_linux(parsed, keep=["id"])
    return done.select(F.col("id").alias("event_id"), "timestamp", "source", "actor", "target", "event_type", "severity",
                       "mitre_technique")


def _syslog_lines(spark, folder) -> DataFrame:
    """Five kinds of device messages from lineitem, in both syslog formats."""
    li = load(spark, folder, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.col("l_suppkey") % 5
    said = (
        F.when(kind == 0, F.concat(F.lit("block in on em0 "), k.cast("string")))
        .when(kind == 1, F.concat(F.lit("DROP IN=eth0 SRC=10.0.0.5 DST=10.3.0."), (F.col("l_partkey") % 250).cast("string"), F.lit(" DPT=22")))
        .when(kind == 2, F.concat(F.lit("%SEC-LOGIN-4-LOGIN_FAILED: Login failed "), k.cast("string")))
        .when(kind == 3, F.concat(F.lit("EventID=4625, Account failed "), k.cast("string")))
        .otherwise(F.concat(F.lit("link is up "), k.cast("string"))))
    app = F.when(kind == 0, "filterlog").when(kind == 1, "kernel").otherwise("daemon")
    pri = (F.col("l_partkey") % 192).cast("string")
    host = F.concat(F.lit("dev"), (F.col("l_suppkey") % 30).cast("string"))
    old = F.concat(F.lit("<"), pri, F.lit(">"), F.date_format("l_shipdate", "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(" "), app, F.lit("[12]: "), said)
    new = F.concat(F.lit("<"), pri, F.lit(">1 "), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z "), host, F.lit(" "), app, F.lit(" 12 - - "), said)
    return li.select(k.alias("k"), F.when(F.col("l_linenumber") % 2 == 0, old).otherwise(new).alias("value"))


_SYS = """WITH s AS (SELECT *, l_orderkey * 10 + l_linenumber AS k, l_suppkey % 5 AS kind, l_partkey % 192 AS pri, concat('dev', l_suppkey % 30) AS host,
 CASE WHEN l_linenumber % 2 = 0 THEN make_timestamp(2024, month(l_shipdate), day(l_shipdate), 0, 0, 0) ELSE l_shipdate END AS t FROM lineitem
 WHERE NOT (l_linenumber % 2 = 0 AND month(l_shipdate) = 2 AND day(l_shipdate) = 29)),
p AS (SELECT *, CASE kind WHEN 0 THEN concat('block in on em0 ', k) WHEN 1 THEN concat('DROP IN=eth0 SRC=10.0.0.5 DST=10.3.0.', l_partkey % 250, ' DPT=22')
 WHEN 2 THEN concat('%SEC-LOGIN-4-LOGIN_FAILED: Login failed ', k) WHEN 3 THEN concat('EventID=4625, Account failed ', k) ELSE concat('link is up ', k) END AS said FROM s)"""
_SYS = _SYS.replace("\n WHERE NOT (l_linenumber % 2 = 0 AND month(l_shipdate) = 2 AND day(l_shipdate) = 29)", "")


@query("syslog_messages", _SYS + """ SELECT k, pri // 8 AS facility, pri % 8 AS pri_severity, t AS timestamp, host AS hostname,
 CASE kind WHEN 0 THEN 'filterlog' WHEN 1 THEN 'kernel' ELSE 'daemon' END AS app, '12' AS proc_id, said AS message,
 CASE WHEN l_linenumber % 2 = 0 THEN 'rfc3164' ELSE 'rfc5424' END AS format,
 CASE kind WHEN 0 THEN 'pfsense' WHEN 1 THEN 'iptables' WHEN 2 THEN 'cisco' WHEN 3 THEN 'windows-forwarded' ELSE 'generic' END AS device FROM p""")
def _(spark, folder):
    parsed = normalize.parse_syslog(_syslog_lines(spark, folder), 2024, AS_OF).drop("value")
    return parsed.withColumns({
        "device": normalize.device_type(F.col("hostname"), F.col("app"), F.col("message")),
        "facility": F.col("facility").cast("long"), "pri_severity": F.col("pri_severity").cast("long")})


@query("network_events", _SYS + """ SELECT said AS raw_payload, t AS timestamp, host AS source, CASE kind WHEN 3 THEN 'windows' ELSE 'network' END AS platform,
 CASE kind WHEN 3 THEN 'unknown' ELSE host END AS actor,
 CASE kind WHEN 1 THEN concat('10.3.0.', l_partkey % 250) WHEN 3 THEN host ELSE 'unknown' END AS target,
 CASE WHEN kind IN (2, 3) THEN 'auth' ELSE 'network' END AS event_type,
 CASE kind WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE ([10, 9, 8, 7, 5, 3, 2, 1])[pri % 8 + 1] END AS severity,
 CASE kind WHEN 3 THEN 4625 ELSE 0 END AS raw_event_id,
 CASE kind WHEN 0 THEN concat('pfSense firewall block: ', said) WHEN 1 THEN concat('iptables DROP: ', said)
  WHEN 2 THEN concat('[SEC-LOGIN-4-LOGIN_FAILED] Login failed ', k) WHEN 3 THEN 'Failed logon attempt' ELSE said END AS description,
 CASE kind WHEN 0 THEN 'T1562' WHEN 1 THEN 'T1046' WHEN 3 THEN 'T1110' ELSE '' END AS mitre_technique FROM p""")
def _(spark, folder):
    done = normalize.normalise_network(normalize.parse_syslog(_syslog_lines(spark, folder), 2024, AS_OF))
    return done.select("raw_payload", "timestamp", "source", "platform", "actor", "target", "event_type", "severity",
                       "raw_event_id", "description", "mitre_technique")


@query("text_cleaning", """
SELECT doc_id, CASE WHEN len(text) > 120 THEN concat(left(text, 120), '...') ELSE text END AS short,
 len(string_split(text, '.')) = 4 OR contains(text, ':') AS ip_like,
 nullif(regexp_extract(text, '(?i)mail[=:\\s]+([^\\s,|]+)', 1), '') AS mail FROM documents""")
def _(spark, folder):
    body = F.col("text")
    return load(spark, folder, "documents").select(
        "doc_id", text.truncate_text(body, 120).alias("short"), text.looks_like_ip(body).alias("ip_like"),
        text.payload_kv(body, "mail").alias("mail"))


@query("time_parsing", """
SELECT event_id, ts AS iso, ts AS filetime, ts AS windows FROM events""")
def _(spark, folder):
    ev = load(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ticks = F.unix_micros("t") * 10 + times.FILETIME_UNIX_EPOCH
    return ev.select("event_id", times.iso_ts(iso).alias("iso"), times.filetime_ts(ticks, AS_OF).alias("filetime"),
                     times.windows_ts(F.regexp_replace(iso, "Z$", "+00:00"), AS_OF).alias("windows"))


# ---- Tables ----

@events_query("dedup_events", with_ctes(
    f"SELECT {EV} FROM u WHERE CAST(event_id AS BIGINT) % 7 <> 3", "u"))
def _(ev):
    copies = ev.unionByName(ev).unionByName(ev.filter("platform = 'windows'"))
    return tables.dedup_events(copies, ev.filter("CAST(event_id AS BIGINT) % 7 = 3")).select(*EV_LIST)


@events_query("retention", with_ctes(
    """SELECT timestamp < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS AS archived, count(*) AS count, min(timestamp) AS first, max(timestamp) AS last FROM u GROUP BY 1""", "u"))
def _(ev):
    live, old = tables.split_retention(ev, AS_OF, 10)

    def part(df, flag):
        return df.agg(F.count("*").alias("count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).withColumn("archived", F.lit(flag))

    return part(live, False).unionByName(part(old, True))


@events_query("latest_by_key", with_ctes(
    "SELECT actor, max(timestamp) AS timestamp, arg_max(source, timestamp) AS source, arg_max(severity, timestamp) AS severity FROM u GROUP BY 1", "u"))
def _(ev):
    return tables.latest_by_key(ev.select("actor", "timestamp", "source", "severity"), "actor", "timestamp")


@events_query("incremental_pull", with_ctes(
    """SELECT computer, channel, max(mark) AS mark, sum(n) AS fresh FROM (
     SELECT source AS computer, platform AS channel, max(timestamp) + INTERVAL 1 MILLISECOND AS mark, count(*) AS n FROM u JOIN
      (SELECT source AS s, platform AS p, max(timestamp) AS moment FROM u WHERE timestamp < '2024-01-15' AND source <> 'host-5' GROUP BY 1, 2) m ON s = source AND p = platform AND timestamp > moment
     GROUP BY 1, 2
     UNION ALL SELECT source, platform, max(timestamp) + INTERVAL 1 MILLISECOND, count(*) FROM u WHERE source = 'host-5' AND timestamp > TIMESTAMP '2024-01-20' - INTERVAL 60 SECONDS GROUP BY 1, 2)
    GROUP BY 1, 2""", "u"))
def _(ev):
    rows = ev.withColumnsRenamed({"source": "computer", "platform": "channel"})
    marks = rows.filter("timestamp < '2024-01-15' AND computer != 'host-5'").groupBy("computer", "channel").agg(F.max("timestamp").alias("mark"))
    fresh, moved = files.incremental(rows, marks, "2024-01-20")
    return moved.join(fresh.groupBy("computer", "channel").agg(F.count("*").alias("fresh")), ["computer", "channel"])


ORACLES["incremental_pull"] = ORACLES["incremental_pull"].replace("sum(n) AS fresh", "CAST(sum(n) AS BIGINT) AS fresh")


# ---- Tables written and read back ----

@events_query("stored_events", with_ctes(
    f"SELECT {EV} FROM u WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'", "u"))
def _(ev):
    path = scratch_folder(ev.sparkSession)
    tables.append_events(ev.filter("raw_event_id % 2 = 0 OR severity > 6"), path)
    tables.append_events(ev, path)  # what is stored already stays as it is
    return tables.scan_archive(ev.sparkSession, path, "2024-01-05 06:00:00", "2024-01-20 18:00:00").select(*EV_LIST)


@events_query("stored_alerts", with_ctes(f"SELECT {_ALERT_SQL} FROM alerts", "alerts"))
def _(ev):
    path, alerts = scratch_folder(ev.sparkSession), _stored_alerts(ev)
    tables.append_alerts(alerts.filter("severity_score >= 7"), path)
    tables.append_alerts(alerts, path)
    return ev.sparkSession.read.parquet(path).select(*_ALERT)


@events_query("stored_snapshot", with_ctes("SELECT entity_id, risk_score, last_seen FROM snap", "snap"))
def _(ev):
    path = scratch_folder(ev.sparkSession)
    snapshot = reliable(_snapshot(ev))
    tables.save_snapshot(snapshot.withColumn("risk_score", F.lit(1.5)), path, "2024-02-01")
    tables.save_snapshot(snapshot, path, "2024-02-02")
    return tables.load_snapshot(ev.sparkSession, path).select("entity_id", "risk_score", "last_seen")


@events_query("stored_timeline", with_ctes(
    """SELECT actor AS entity_id, timestamp, event_id, severity FROM d
    WHERE severity >= 6 OR len(flags) > 0 OR event_id IN (SELECT event_id FROM runs WHERE run > 0)""", "d", "runs"))
def _(ev):
    path = scratch_folder(ev.sparkSession)
    tables.append_timeline(entities.entity_timeline(ev, 6, 2, stale_days=STALE_DAYS), path)
    return ev.sparkSession.read.parquet(path).select("entity_id", "timestamp", "event_id", "severity")


@events_query("content_ids", with_ctes(
    "SELECT event_id, sha256(concat_ws(chr(1), event_id, actor, source, raw_payload)) AS content_id FROM u", "u"))
def _(ev):
    return ev.select("event_id", text.content_id(F.col("event_id"), F.col("actor"), F.col("source"), F.col("raw_payload")).alias("content_id"))


_MARKERS = "CASE raw_event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'NULL' WHEN 3 THEN concat('  ', source, ' ') WHEN 4 THEN NULL ELSE actor END"


@events_query("value_markers", with_ctes(
    f"""SELECT event_id, CASE WHEN trim(coalesce(v, '')) IN ('', '-', 'N/A', 'NULL') THEN '' ELSE trim(v) END AS value
    FROM (SELECT event_id, {_MARKERS} AS v FROM u)""", "u"))
def _(ev):
    return ev.select("event_id", text.clean_value(F.expr(_MARKERS)).alias("value"))


@events_query("sigma_without", with_ctes(
    "SELECT sigma_rule_id, count(*) AS matches FROM sig WHERE sigma_rule_id NOT IN ('builtin-004', 'builtin-010') GROUP BY 1", "sig"))
def _(ev):
    pack = sigma.RulePack.builtin().without("builtin-004").without("builtin-010")
    return sigma.sigma_match(ev, pack).groupBy("sigma_rule_id").agg(F.count("*").alias("matches"))


# A pack of about 2,400 rules: a value of two fields, or a text of the payload, and some that match nothing.
@events_query("sigma_indexed", with_ctes("""SELECT concat('pair-', raw_event_id, '-', source) AS sigma_rule_id, event_id FROM u
 UNION ALL SELECT concat('text-', json_extract_string(raw_payload, '$.k')), event_id FROM u
 UNION ALL SELECT concat('not-', source), event_id FROM u WHERE raw_event_id = 4625 AND NOT (starts_with(actor, 'svc_') OR platform = 'linux')""", "u"))
def _(ev):
    rules = [(f"pair-{i}-host-{h}", {"sel": {"EventID": i, "Computer": f"HOST-{h}"}, "condition": "sel"})
             for i in fixed.WINDOWS_EVENTS for h in range(20)]
    rules += [(f"text-{k}", {"keywords": [f'"k": {k}}}'], "condition": "keywords"}) for k in range(1000)]
    rules += [(f"not-host-{h}", {"sel": {"Computer": f"host-{h}", "EventID": 4625}, "a": {"SubjectUserName|startswith": "svc_"},
                                 "b": {"Platform": "linux"}, "condition": "sel and not (a or b)"})
              for h in range(20)]
    pack = sigma.RulePack(tuple(sigma.compile_rule({"id": i, "title": i, "detection": d}) for i, d in rules))
    return sigma.sigma_match(ev, pack, indexed_matches).select("sigma_rule_id", "event_id")


_TEXT = "id: {0}\ntitle: {0} {1}\ndescription: about {1}\nlevel: {2}\ndetection: {{sel: {{EventID: {3}}}, condition: sel}}"
_FIRST = [  # rules of the first day, and what happened to them then
    rule_versions.imported(_TEXT.format("cleared", "v1", "high", 1102), "2024-01-01"),
    rule_versions.imported(_TEXT.format("groups", "v1", "low", "[4732, 4728]"), "2024-01-01"),
    rule_versions.imported(_TEXT.format("logons", "v1", "low", 4624), "2024-01-01"),
    rule_versions.disabled("groups", "2024-01-10 12:00:00"),
]
_LATER = [
    rule_versions.imported(_TEXT.format("cleared", "v2", "critical", "[1102, 4720]"), "2024-01-15"),
    rule_versions.disabled("logons", "2024-01-05"),
    rule_versions.enabled("logons", "2024-01-20"),
    rule_versions.imported(_TEXT.format("shares", "v1", "medium", 5140), "2024-01-12 06:30:00"),
]
_VALID_SQL = """SELECT rule_id AS sigma_rule_id, v AS title, level, u.event_id, u.timestamp FROM u JOIN (VALUES
  ('cleared', 'v1', 'high', [1102], TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15'), ('cleared', 'v2', 'critical', [1102, 4720], '2024-01-15', '9999-01-01'),
  ('groups', 'v1', 'low', [4732, 4728], '2024-01-01', '2024-01-10 12:00:00'), ('logons', 'v1', 'low', [4624], '2024-01-01', '2024-01-05'),
  ('logons', 'v1', 'low', [4624], '2024-01-20', '9999-01-01'), ('shares', 'v1', 'medium', [5140], '2024-01-12 06:30:00', '9999-01-01')
 ) r(rule_id, v, level, ids, since, until) ON list_contains(ids, raw_event_id) AND timestamp >= since AND timestamp < until"""


def _history(spark: SparkSession) -> rule_versions.RuleHistory:
    path = scratch_folder(spark)
    for batch, changes in enumerate((_FIRST, _LATER, _LATER)):  # the last one is a repeated run
        rule_versions.append_changes(spark, path, changes, min(batch, 1))
    return rule_versions.RuleHistory.of(rule_versions.read_changes(spark, path))


@events_query("sigma_versions", with_ctes(
    f"SELECT sigma_rule_id, concat(sigma_rule_id, ' ', title) AS title, upper(level) AS severity, event_id FROM ({_VALID_SQL})", "u"))
def _(ev):
    return _history(ev.sparkSession).alerts(ev).select("sigma_rule_id", "title", "severity", "event_id")


@events_query("rule_list", with_ctes(f"""SELECT r.*, coalesce(match_count, 0) AS match_count, last_matched FROM (VALUES
  ('cleared', 2, 'cleared v2', 'about v1', 'critical', true, TIMESTAMP '2024-01-15'), ('groups', 2, 'groups v1', 'about v1', 'low', false, '2024-01-10 12:00:00'),
  ('logons', 2, 'logons v1', 'about v1', 'low', false, '2024-01-05'), ('shares', 1, 'shares v1', 'about v1', 'medium', true, '2024-01-12 06:30:00')
 ) r(rule_id, version, title, description, level, is_active, loaded_at) LEFT JOIN (SELECT sigma_rule_id, count(*) AS match_count, max(timestamp) AS last_matched
  FROM ({_VALID_SQL}) WHERE timestamp <= TIMESTAMP '2024-01-18' GROUP BY 1) ON sigma_rule_id = rule_id""", "u"))
def _(ev):
    history = _history(ev.sparkSession)
    return rule_versions.list_rules(history, history.alerts(ev), "2024-01-18", active_only=False).select(
        "rule_id", "version", "title", "description", "level", "is_active", "loaded_at", "match_count", "last_matched")


def _rollup(ev) -> Rollup:
    """Counts kept over four batches, each with events of all days, folded after the second; the third arrives twice."""
    rollup = Rollup(ev.sparkSession, scratch_folder(ev.sparkSession))
    for i in (0, 1, 2, 2, 3):
        rollup.append(ev.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i), i)
        if i == 1:
            rollup.compact()
    return rollup


@events_query("rollup_dashboard", ORACLES["event_dashboard"])
def _(ev):
    return _rollup(ev).dashboard(ev, AS_OF)


@events_query("rollup_timeline", with_ctes(
    """SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(*) AS count, max(severity) AS max_severity FROM u
    WHERE timestamp >= '2024-01-05 10:20:30' AND timestamp <= '2024-01-25 00:00:01.5' AND platform='windows' GROUP BY 1""", "u"))
def _(ev):
    return _rollup(ev).timeline(ev, AS_OF, "hour", "2024-01-05 10:20:30", "2024-01-25 00:00:01.5", "windows")
