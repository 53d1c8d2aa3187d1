"""Independent SQL for the registered queries, built from named CTEs. Written for DuckDB over the test tables."""

from __future__ import annotations

from pathlib import Path

import yaml

W = "INTERVAL 86400 SECONDS"

CTES: dict[str, str] = {}

CTES["b"] = "SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events"
CTES["m"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS timestamp,
  CASE WHEN k % 5 < 3 THEN 'windows' WHEN k % 5 = 3 THEN 'linux' ELSE 'network' END AS platform,
  concat('host-', CAST(k % 20 AS VARCHAR)) AS source,
  CASE WHEN k % 11 = 0 THEN concat('10.0.0.', CAST(user_id % 250 AS VARCHAR))
       WHEN k % 11 = 1 THEN concat('svc_', CAST(user_id AS VARCHAR))
       ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS actor,
  CASE event_type WHEN 'error' THEN 4625 WHEN 'click' THEN 4624 WHEN 'signup' THEN 4732
     WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 7045 ELSE 4698 END
     ELSE CASE WHEN k % 3 = 0 THEN 1102 WHEN k % 3 = 1 THEN 4720 ELSE 5140 END END AS raw_event_id,
  props AS raw_payload FROM b"""
CTES["u"] = """
SELECT *, source AS target, epoch_us(timestamp) AS us,
 CASE WHEN raw_event_id IN (4624,4625) THEN 'auth' WHEN raw_event_id=4698 THEN 'process' WHEN raw_event_id=5140 THEN 'network' ELSE 'config' END AS event_type,
 CASE raw_event_id WHEN 4625 THEN 6 WHEN 4624 THEN 2 WHEN 4732 THEN 7 WHEN 7045 THEN 9 WHEN 4698 THEN 8 WHEN 1102 THEN 10 WHEN 4720 THEN 7 ELSE 5 END AS severity,
 CASE raw_event_id WHEN 4625 THEN 'Failed logon attempt' WHEN 4624 THEN 'Successful logon' WHEN 4732 THEN 'User added to local security group' WHEN 7045 THEN 'New service installed on system' WHEN 4698 THEN 'Scheduled task created' WHEN 1102 THEN 'Security audit log cleared' WHEN 4720 THEN 'User account created' ELSE 'Network share object accessed' END AS description
FROM m"""
CTES["f"] = """
SELECT *, (raw_event_id=4625 OR (event_type='auth' AND lower(description) LIKE '%fail%')) AS fail,
 (raw_event_id=4624 OR (event_type='auth' AND lower(description) LIKE '%success%')) AS ok,
 (raw_event_id=4624 OR event_type='auth') AS auth FROM u"""

FRAME = f"ORDER BY timestamp RANGE BETWEEN {W} PRECEDING AND CURRENT ROW"
# Per event: windowed counts, evidence lists and hosts, by actor and by source.
CTES["w"] = f"""
SELECT *,
 count(*) FILTER (fail) OVER a AS n_fail, count(*) FILTER (raw_event_id=4624) OVER a AS n_logon,
 count(*) FILTER (auth) OVER a AS n_auth, count(*) OVER a AS n_all,
 list(event_id) FILTER (fail) OVER a AS l_fail, list(event_id) FILTER (raw_event_id=4624) OVER a AS l_logon,
 list(event_id) FILTER (auth) OVER a AS l_auth,
 min(us) FILTER (fail) OVER a AS t_fail, min(us) FILTER (auth) OVER a AS t_auth,
 list_sort(list_distinct(list(source) FILTER (auth) OVER a)) AS hosts,
 count(*) FILTER (auth) OVER s AS n_src, list(event_id) FILTER (auth) OVER s AS l_src,
 count(*) OVER p AS n_pair
FROM f WINDOW a AS (PARTITION BY actor {FRAME}), s AS (PARTITION BY source {FRAME}),
 p AS (PARTITION BY actor, source {FRAME})"""

_CAND = "actor, target, source AS source_host, timestamp, event_id"


def _rule(stage, name, severity, score, title, technique, tactic, cond, description, ids, extra=""):
    return f"""SELECT {stage} AS stage, '{name}' AS alert_type, '{severity}' AS severity, {score} AS severity_score,
 {title} AS title, {description} AS description, {_CAND}, CAST(NULL AS VARCHAR) AS sigma_rule_id,
 {technique} AS mitre_technique, {tactic} AS mitre_tactic, {ids} AS event_ids FROM w WHERE {cond}"""


RULES = {
    "brute_force": _rule(
        20001, "brute_force", "HIGH", 7, "concat('Brute Force Attack - ', actor)", "'T1110'", "'credential-access'",
        "fail AND n_fail >= 3",
        "concat(n_fail, ' failed authentication attempts against ''', actor, ''' from ', source, ' within ', (us - t_fail) // 1000000, 's')",
        "l_fail[-10:]"),
    "credential_stuffing": _rule(
        20002, "credential_stuffing", "CRITICAL", 10, "concat('Successful Login After Failures - ', actor)",
        "'T1110.004'", "'credential-access'", "ok AND n_fail >= 2",
        "concat('Account ''', actor, ''' logged in from ', source, ' after ', n_fail, ' failed attempts: a guessed or stolen password is likely.')",
        "list_append(l_fail[-5:], event_id)"),
    "lateral_movement": _rule(
        20003, "lateral_movement", "CRITICAL", 10, "concat('Lateral Movement - ', actor)", "'T1021'",
        "'lateral-movement'", "auth AND len(hosts) >= 2",
        "concat('Actor ''', actor, ''' authenticated to ', len(hosts), ' distinct hosts within ', (us - t_auth) // 1000000, 's: ', array_to_string(hosts[:5], ', '))",
        "l_auth[-10:]"),
    "privilege_escalation_chain": _rule(
        20004, "privilege_escalation_chain", "CRITICAL", 10, "concat('Privilege Escalation Chain - ', actor)", "'T1078'",
        "'privilege-escalation'", "raw_event_id IN (4728,4732,4756) AND n_logon >= 1",
        "concat('Actor ''', actor, ''' logged in and was added to a security group shortly afterwards.')",
        "list_append(l_logon[-3:], event_id)"),
    "persistence_after_auth": _rule(
        20005, "persistence_after_auth", "HIGH", 7, "concat('Persistence After Auth - ', source)",
        "CASE WHEN raw_event_id IN (7045,4697) THEN 'T1543' ELSE 'T1053' END", "'persistence'",
        "raw_event_id IN (7045,4697,4698) AND n_src >= 1",
        "concat(CASE WHEN raw_event_id IN (7045,4697) THEN 'Service Installation' ELSE 'Scheduled Task Creation' END, ' on ''', source, ''' followed a recent authentication on the same host.')",
        "list_append(l_src[-3:], event_id)"),
    "audit_log_cleared": _rule(
        20006, "audit_log_cleared", "CRITICAL", 10, "concat('Audit Log Cleared - ', source)", "'T1070.001'",
        "'defense-evasion'", "raw_event_id = 1102",
        "concat('The Windows security audit log on ''', source, ''' was cleared by ''', actor, '''.')", "[event_id]"),
    "after_hours_auth": _rule(
        20007, "after_hours_auth", "MEDIUM", 5, "concat('After-Hours Authentication - ', actor)", "'T1078'",
        "'defense-evasion'", "auth AND (hour(timestamp) < 7 OR hour(timestamp) >= 18) AND n_all >= 3",
        "concat('Actor ''', actor, ''' authenticated to ''', source, ''' at ', strftime(timestamp, '%H:%M'), ' UTC, outside 07:00-18:00.')",
        "[event_id]"),
    "new_source_auth": _rule(
        20008, "new_source_auth", "MEDIUM", 5, "concat('Authentication From New Source - ', actor)", "'T1078'",
        "'initial-access'", "auth AND source <> 'unknown' AND n_pair = 1 AND n_all >= 5",
        "concat('Actor ''', actor, ''' authenticated from a new source ''', source, '''. Known sources: ', array_to_string(list_filter(list_sort(list_distinct(l_any)), lambda x: x <> source)[:3], ', '), '.')",
        "[event_id]").replace("FROM w", f"FROM (SELECT *, list(source) OVER (PARTITION BY actor {FRAME}) AS l_any FROM w)"),
}
CTES["corr"] = " UNION ALL ".join(RULES.values())



def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The texts of rules and narratives are configuration, not results.
_RESOURCES = Path(__file__).parent.parent / "resources"
RULE_TEXTS = {r["id"]: r for r in yaml.safe_load((_RESOURCES / "builtin_rules.yml").read_text())}
NARRATIVES = yaml.safe_load((_RESOURCES / "narratives.yml").read_text())
NARRATIVE_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"({sql_text(k)}, {sql_text(t['what'])}, {sql_text(t['why'])}, {sql_text(chr(10).join(t['commands']))}, "
    f"{sql_text(chr(10).join(f'{i + 1}. {x}' for i, x in enumerate(t['remediation'])))}, "
    f"{sum(1 for c in t['commands'] if c.strip() and not c.startswith('#'))})"
    for k, t in NARRATIVES.items()) + ") t(template, what, why, commands, steps, runnable)"

# Built-in rules on the adapter events: (rule number, id, title, description, severity, score, technique, tactic, where).
SIGMA = [
    (0, "builtin-001", "CRITICAL", 10, "T1070.001", "defense-evasion", "platform='windows' AND raw_event_id=1102"),
    (1, "builtin-002", "HIGH", 7, "T1543.003", "persistence", "platform='windows' AND raw_event_id=7045"),
    (2, "builtin-003", "MEDIUM", 5, "T1136", "persistence", "platform='windows' AND raw_event_id=4720"),
    (3, "builtin-004", "HIGH", 7, "T1098", "persistence", "platform='windows' AND raw_event_id IN (4728,4732,4756)"),
    (4, "builtin-005", "MEDIUM", 5, "T1053.005", "persistence", "platform='windows' AND raw_event_id=4698"),
    (5, "builtin-006", "LOW", 3, "T1110", "credential-access",
     "platform='linux' AND regexp_matches(lower(raw_payload), 'failed password|authentication failure|invalid user')"),
    (6, "builtin-007", "MEDIUM", 5, "T1548.003", "privilege-escalation", "platform='linux' AND lower(raw_payload) LIKE '%sudo%'"),
    (7, "builtin-008", "MEDIUM", 5, "T1110", "credential-access", "platform='windows' AND raw_event_id=4740"),
    (8, "builtin-009", "HIGH", 7, "T1543.003", "persistence", "platform='windows' AND raw_event_id=4697"),
    (9, "builtin-010", "LOW", 3, "T1039", "collection", "platform='windows' AND raw_event_id IN (5140,5145)"),
]
CTES["sig"] = " UNION ALL ".join(
    f"""SELECT {10000 + i} AS stage, 'sigma:{rid}' AS alert_type, '{sev}' AS severity, {score} AS severity_score,
 {_CAND}, '{rid}' AS sigma_rule_id, '{tech}' AS mitre_technique, '{tac}' AS mitre_tactic, [event_id] AS event_ids,
 {sql_text(RULE_TEXTS[rid]["title"])} AS title, {sql_text(RULE_TEXTS[rid]["description"])} AS description
 FROM f WHERE {where}""" for i, rid, sev, score, tech, tac, where in SIGMA)

# The alert table of the search, report, case and narrative queries: rule packs and window rules, before cooldown.
_KEY = "sha256(concat_ws(chr(1), alert_type, actor, source_host, event_id))"
CTES["alerts"] = f"""
SELECT *, {_KEY} AS alert_id, 'open' AS status FROM (
 SELECT stage, alert_type, severity, severity_score, actor, target, source_host, timestamp, event_id, sigma_rule_id, mitre_technique, mitre_tactic FROM sig
 UNION ALL
 SELECT stage, alert_type, severity, severity_score, actor, target, source_host, timestamp, event_id, sigma_rule_id, mitre_technique, mitre_tactic FROM corr)"""

# Entity behaviour.
CTES["o"] = """
SELECT *, CASE WHEN fail THEN 'auth_failure' WHEN ok THEN 'auth_success' WHEN raw_event_id=1102 THEN 'audit_log_cleared'
  WHEN raw_event_id IN (7045,4697) THEN 'new_service' WHEN raw_event_id=4720 THEN 'new_account_created'
  WHEN raw_event_id IN (4728,4732,4756) THEN 'group_membership_change' WHEN raw_event_id=4698 THEN 'scheduled_task_created'
  WHEN severity >= 7 THEN 'high_severity' ELSE 'plain' END AS branch,
 row_number() OVER (PARTITION BY actor ORDER BY timestamp, event_id) AS event_number,
 count(*) FILTER (fail) OVER (PARTITION BY actor ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS failures,
 row_number() OVER (PARTITION BY actor, source ORDER BY timestamp, event_id) AS on_host,
 us - lag(us) OVER (PARTITION BY actor ORDER BY timestamp, event_id) AS idle
FROM f WHERE NOT (actor = 'unknown' AND severity < 3)"""
CTES["d"] = """
SELECT *, list_filter([
  CASE WHEN branch='auth_success' AND on_host=1 AND source<>'unknown' THEN 'new_host_access' END,
  CASE WHEN branch IN ('audit_log_cleared','new_service','new_account_created','group_membership_change','scheduled_task_created') THEN branch END,
  CASE WHEN event_type='auth' AND event_number > 10 AND (hour(timestamp) >= 22 OR hour(timestamp) <= 5) THEN 'after_hours_access' END,
  CASE WHEN event_type='auth' AND idle >= {stale} THEN 'stale_account_active' END], lambda x: x IS NOT NULL) AS flags,
 CASE branch WHEN 'auth_failure' THEN 3 WHEN 'audit_log_cleared' THEN 40 WHEN 'new_service' THEN 15 WHEN 'new_account_created' THEN 20
   WHEN 'group_membership_change' THEN 15 WHEN 'scheduled_task_created' THEN 10 WHEN 'high_severity' THEN 5 ELSE 0 END
 + CASE WHEN branch='auth_success' AND on_host=1 AND source<>'unknown' THEN 5 ELSE 0 END
 + CASE WHEN event_type='auth' AND event_number > 10 AND (hour(timestamp) >= 22 OR hour(timestamp) <= 5) THEN 8 ELSE 0 END
 + CASE WHEN event_type='auth' AND idle >= {stale} THEN 20 ELSE 0 END AS risk_own
FROM o""".replace("{stale}", str(7 * 86_400_000_000))
# Runs of failures ended by a success: step through the successes of each actor, carrying the last reset.
CTES["okrows"] = """
SELECT *, row_number() OVER (PARTITION BY actor ORDER BY timestamp, event_id) AS rn FROM d WHERE branch='auth_success'"""
CTES["runs"] = """
SELECT actor, event_id, rn, failures, CASE WHEN failures >= 2 THEN failures ELSE 0 END AS last,
  CASE WHEN failures >= 2 THEN failures ELSE 0 END AS run FROM okrows WHERE rn = 1
UNION ALL
SELECT n.actor, n.event_id, n.rn, n.failures, CASE WHEN n.failures - r.last >= 2 THEN n.failures ELSE r.last END,
  CASE WHEN n.failures - r.last >= 2 THEN n.failures - r.last ELSE 0 END
FROM runs r JOIN okrows n ON n.actor = r.actor AND n.rn = r.rn + 1"""
# Distinct sources among the last 100 events of an actor that lie in the window.
CTES["lat"] = f"""
SELECT actor, target, source, timestamp, event_id, us, list_sort(list_distinct(list_transform(list_filter(l, lambda x: x.t >= timestamp - {W}), lambda x: x.s))) AS hosts
FROM (SELECT *, list({{'s': source, 't': timestamp}}) OVER (PARTITION BY actor ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS l
      FROM u WHERE actor <> 'unknown')"""
CTES["r"] = """
SELECT d.*, d.risk_own + CASE WHEN len(lat.hosts) >= 2 THEN 30 ELSE 0 END AS risk_added, coalesce(len(lat.hosts) >= 2, false) AS moved
FROM d LEFT JOIN lat ON lat.event_id = d.event_id AND lat.actor = d.actor"""
CTES["dev"] = """
SELECT flag, actor, target, source, timestamp, event_id,
 CASE flag WHEN 'audit_log_cleared' THEN 'CRITICAL' WHEN 'new_host_access' THEN 'MEDIUM' WHEN 'scheduled_task_created' THEN 'MEDIUM'
   WHEN 'after_hours_access' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
 CASE flag WHEN 'audit_log_cleared' THEN 10 WHEN 'new_host_access' THEN 5 WHEN 'scheduled_task_created' THEN 5
   WHEN 'after_hours_access' THEN 5 ELSE 7 END AS severity_score,
 CASE flag WHEN 'new_host_access' THEN concat('First seen on ', source) WHEN 'audit_log_cleared' THEN 'Security audit log was cleared'
   WHEN 'new_service' THEN concat('New service installed: ', description) WHEN 'new_account_created' THEN concat('New user account created by ', actor)
   WHEN 'group_membership_change' THEN concat(actor, ' added to security group') WHEN 'scheduled_task_created' THEN concat('Scheduled task created by ', actor)
   WHEN 'after_hours_access' THEN concat('Authentication at ', strftime(timestamp, '%H:%M'), ' UTC')
   WHEN 'stale_account_active' THEN 'Account inactive for 7+ days, now active'
   ELSE concat(run, ' failures before success') END AS description
FROM (SELECT unnest(flags) AS flag, actor, target, source, timestamp, event_id, description, NULL AS run FROM d
      UNION ALL
      SELECT 'success_after_failures', d.actor, d.target, d.source, d.timestamp, d.event_id, d.description, runs.run
      FROM runs JOIN d ON d.event_id = runs.event_id AND d.actor = runs.actor WHERE runs.run > 0)"""
_TYPE = r"""CASE WHEN {c} IS NULL OR {c} IN ('', 'unknown') THEN 'user'
 WHEN regexp_matches({c}, '^\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}$') THEN 'ip'
 WHEN contains({c}, ':') AND regexp_full_match(split_part({c}, '@', 1), '[0-9a-fA-F:]+') THEN 'ip'
 WHEN len(string_split({c}, '@')) = 2 AND regexp_matches(split_part({c}, '@', 2), '^\d{{1,3}}\.\d{{1,3}}') THEN 'user'
 WHEN regexp_matches({c}, '^svc_|^service_|^_|^\$|SYSTEM$|LOCAL SERVICE$|NETWORK SERVICE$|^NT AUTHORITY', 'i') THEN 'service'
 WHEN contains({c}, '.') AND NOT starts_with({c}, '\') AND NOT list_contains(string_split({c}, '.'), '') THEN 'host'
 WHEN ends_with({c}, '$') THEN 'host' ELSE 'user' END"""


def entity_type(c: str) -> str:
    return _TYPE.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def risk_label(c: str) -> str:
    return (f"CASE WHEN {c} >= 80 THEN 'CRITICAL' WHEN {c} >= 60 THEN 'HIGH' WHEN {c} >= 40 THEN 'MEDIUM' "
            f"WHEN {c} >= 20 THEN 'LOW' ELSE 'CLEAN' END")


CTES["snap"] = f"""
SELECT *, {entity_type('entity_id')} AS entity_type, {risk_label('risk_score')} AS risk_label FROM (
 SELECT actor AS entity_id, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS event_count,
  CAST(least(100, sum(risk_added)) AS DOUBLE) AS risk_score,
  coalesce(max(timestamp) FILTER (risk_added > 0), min(timestamp)) AS last_risk_update,
  count(*) FILTER (branch='auth_failure') - coalesce(max((SELECT max(failures) FROM runs WHERE runs.actor = r.actor AND runs.run > 0)), 0) AS auth_failures,
  count(*) FILTER (branch='auth_success') AS auth_successes,
  array_to_string(list_sort(list(DISTINCT source) FILTER (source<>'unknown'))[:20], ',') AS known_hosts,
  count(DISTINCT source) FILTER (source<>'unknown') AS known_host_count,
  array_to_string(list_sort(list(DISTINCT hour(timestamp))), ',') AS active_hours,
  array_to_string(list_sort(list(DISTINCT event_type)), ',') AS known_event_types,
  array_to_string(list_sort(list_distinct(flatten([coalesce(flatten(list(flags)), []),
    CASE WHEN bool_or(moved) THEN ['lateral_movement'] ELSE [] END,
    CASE WHEN max((SELECT max(run) FROM runs WHERE runs.actor = r.actor)) > 0 THEN ['success_after_failures'] ELSE [] END]))), ',') AS deviation_flags
 FROM r GROUP BY actor
 UNION ALL
 SELECT source, min(timestamp), min(timestamp), 0, 0.0, min(timestamp), 0, 0, '', 0, '', '', '' FROM r
 WHERE source <> 'unknown' AND source <> actor AND source NOT IN (SELECT actor FROM r) GROUP BY source)"""
# All candidate alerts of the detection plan, and the greedy cooldown of 2 hours stepped per (type, actor, host).
CTES["cand"] = """
SELECT stage, alert_type, severity, severity_score, title, description, actor, target, source_host, timestamp, event_id, event_ids, mitre_technique, mitre_tactic FROM corr
UNION ALL SELECT 0, flag, severity, severity_score, concat(
   array_to_string(list_transform(string_split(flag, '_'), lambda x: concat(upper(x[1]), x[2:])), ' '), ' - ', actor),
   description, actor, target, source, timestamp, event_id, [event_id], '', '' FROM dev
UNION ALL SELECT 30000, 'lateral_movement', 'CRITICAL', 10, t, t, actor, target, source, timestamp, event_id, [event_id], '', '' FROM (
   SELECT *, concat(actor, ' authenticated to ', len(hosts), ' distinct hosts within 1440 minutes: ', array_to_string(hosts[:5], ', ')) AS t
   FROM lat WHERE len(hosts) >= 2)
UNION ALL SELECT stage, alert_type, severity, severity_score, title, description, actor, target, source_host, timestamp, event_id, event_ids, mitre_technique, mitre_tactic FROM sig"""
CTES["firsts"] = """
SELECT *, row_number() OVER (PARTITION BY alert_type, actor, source_host ORDER BY timestamp) AS rn FROM (
 SELECT *, row_number() OVER (PARTITION BY alert_type, actor, source_host, timestamp ORDER BY event_id, stage) AS one FROM cand) WHERE one = 1"""
CTES["cool"] = """
SELECT alert_type, actor, source_host, rn, timestamp AS last, true AS keep FROM firsts WHERE rn = 1
UNION ALL
SELECT n.alert_type, n.actor, n.source_host, n.rn,
  CASE WHEN n.timestamp >= c.last + INTERVAL 7200 SECONDS THEN n.timestamp ELSE c.last END, n.timestamp >= c.last + INTERVAL 7200 SECONDS
FROM cool c JOIN firsts n ON n.alert_type = c.alert_type AND n.actor = c.actor AND n.source_host = c.source_host AND n.rn = c.rn + 1"""
CTES["kept"] = """
SELECT firsts.* FROM firsts JOIN cool USING (alert_type, actor, source_host, rn) WHERE keep"""

_NEEDS = {
    "m": ["b"], "u": ["m"], "f": ["u"], "w": ["f"], "corr": ["w"], "sig": ["f"], "alerts": ["sig", "corr"], "o": ["f"],
    "d": ["o"], "okrows": ["d"], "runs": ["okrows"], "lat": ["u"], "r": ["d", "lat"], "dev": ["d", "runs"],
    "snap": ["r", "runs"], "cand": ["corr", "dev", "lat", "sig"], "firsts": ["cand"], "cool": ["firsts"],
    "kept": ["firsts", "cool"],
}
_RECURSIVE = {"runs", "cool"}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named CTEs and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    word = "WITH RECURSIVE" if _RECURSIVE & set(order) else "WITH"
    return f"{word} {', '.join(parts)} {body}" if parts else body
