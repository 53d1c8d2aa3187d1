"""Parsers, validation, rule packs, carving and tables on hand-made input."""

import struct
import tempfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import text
from tracewarden.operators import normalize as n
from tracewarden.operators import sigma as g
from tracewarden.operators import validate as v
from tracewarden.sources import evtx, files, tables

AS_OF = "2024-02-01 00:00:00"


def fresh() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def lines(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "value string")


def test_validation_cases(spark):
    base = '{"event_id":"%s","timestamp":"2024-01-15T02:33:47.123456789Z","platform":"%s","source":"s"%s}'
    texts = {
        "a": base % ("a", "Windows", ',"event":{"type":"auth","severity":-1}'),
        "b": base % ("b", "mainframe", ',"event":{"severity":11}'),
        "c": base % ("c", "linux", ',"event":{"severity":"7"},"entity":{"actor":"bob"}'),
        "d": base % ("d", "linux", ',"event":{"severity":"7.5"},"entity":5'),
        "e": base % ("e", "linux", ',"event":{"severity":7.5},"mitre":[1]'),
        "f": base % ("f", "linux", ',"event":{"severity":null,"raw_event_id":4625}'),
        "g": (base % ("g", "linux", "")).replace("2024-01-15T", "soon"),
    }
    bad = ['{"event_id":"x","platform":"linux","source":"s"}', "{broken", "[1]"]
    valid, rejected = v.parse_event_json(lines(spark, *texts.values(), *bad), AS_OF)
    rows = {r["event_id"]: r for r in valid.collect()}
    assert [rows[k]["severity"] for k in "abcdefg"] == [0, 10, 7, 1, 7, 1, 1]
    assert rows["a"]["platform"] == "windows" and rows["b"]["platform"] == "unknown"
    assert rows["c"]["actor"] == "bob" and rows["d"]["actor"] == "unknown" and rows["f"]["raw_event_id"] == 4625
    assert rows["a"]["timestamp"] == datetime(2024, 1, 15, 2, 33, 47, 123456)
    assert rows["g"]["timestamp"] == datetime(2024, 2, 1) and rows["g"]["event_type"] == "unknown"
    assert rows["b"]["event_type"] == "system"
    assert sorted(r["reason"] for r in rejected.collect()) == [
        "invalid json", "invalid json", "missing required field: timestamp"]


def test_linux_strict_and_default(spark):
    df = lines(
        spark, "Jan 15 02:33:47 web01 sshd[123]: Failed password for invalid user admin from 10.0.0.5 port 22 ssh2",
        "Jan  5 02:34:00 web01 sudo: bob : TTY=pts/0", "plain text with no header").withColumn("hostname", F.lit("web01"))
    parsed = n.parse_linux_lines(df, 2024, AS_OF)
    got = [tuple(r) for r in n.normalise_linux(parsed).select("timestamp", "actor", "target", "severity").collect()]
    assert got == [(datetime(2024, 1, 15, 2, 33, 47), "admin", "10.0.0.5", 6), (datetime(2024, 1, 5, 2, 34), "bob", "web01", 5),
                   (datetime(2024, 2, 1), "text", "web01", 1)]
    strict = [tuple(r) for r in n.normalise_linux(parsed, strict=True).select("actor", "severity").collect()]
    assert strict == [("sshd", 6), ("bob", 1), ("text", 1)]


def test_noise_and_text_helpers(spark):
    noise = ["Jan 15 02:35:00 x CRON[9]: run", "systemd-logind: x", "ntpd[1]: y", "ok line"]
    assert [r[0] for r in lines(spark, *noise).select(n.is_noise(F.col("value"))).collect()] == [True, True, True, False]
    got = lines(spark, " - ", "N/A", "a\x07b", "x" * 130).select(text.clean_text(F.col("value"))).collect()
    assert [r[0] for r in got] == ["unknown", "unknown", "ab", "x" * 128 + "..."]
    ids = lines(spark, "Event ID: 4624 ok", "eventid=4625,", "event id = 1102", "none").select(text.forwarded_id(F.col("value")))
    assert [r[0] for r in ids.collect()] == [4624, 4625, 1102, 0]


def test_syslog_forms(spark):
    df = n.parse_syslog(lines(
        spark, "<34>1 2024-01-15T02:33:47.000Z fw01 filterlog - - - block in", "<189>Jan  5 02:33:47 sw01 app[12]: a: b",
        "<14>Jan 15 02:33:47 onlyhost", "<14>Jan 15 02:33:47 h no tag", "no header", "  "), 2024, AS_OF)
    got = [tuple(r) for r in df.select("facility", "pri_severity", "hostname", "app", "proc_id", "message", "format").collect()]
    assert got == [
        (4, 2, "fw01", "filterlog", "", "block in", "rfc5424"), (23, 5, "sw01", "app", "12", "a: b", "rfc3164"),
        (1, 6, "onlyhost", "", "", "onlyhost", "rfc3164"), (1, 6, "h", "unknown", "", "no tag", "rfc3164"),
        (0, 0, "unknown", "", "", "no header", "raw")]


def test_xml_files_split_at_events(spark):
    event = ('<Event xmlns="x"><System><EventID>{}</EventID><TimeCreated SystemTime="{}"/><Computer>{}</Computer></System>'
             '<EventData><Data Name="targetUSERname"> bob </Data></EventData></Event>')
    folder = fresh()
    Path(folder, "a.xml").write_text("<Objects>" + event.format(4625, "2024-01-15T02:33:47.1234567Z", "ws01") + "\n"
                                     + event.format(1102, "never", "") + "<Event broken></Objects>")
    rows = files.read_windows_xml(spark, folder, AS_OF, "fallback").orderBy("raw_event_id").collect()
    assert [(r["raw_event_id"], r["computer"], r["target_user"]) for r in rows] == [(1102, "fallback", "bob"), (4625, "ws01", "bob")]
    assert rows[0]["timestamp"] == datetime(2024, 2, 1) and rows[1]["timestamp"] == datetime(2024, 1, 15, 2, 33, 47, 123456)


def _record(texts, filetime, number=1):
    body = b"\x01\x0f" + b"".join(t.encode("utf-16-le") + b"\x00\x00" for t in texts)
    size = 24 + len(body) + 4
    return struct.pack("<IIQQ", 0x2A2A, size, number, filetime) + body + struct.pack("<I", size)


def _chunk(*records):
    data = evtx.CHUNK_MAGIC + b"\x00" * (evtx.CHUNK_HEADER - 8) + b"".join(records)
    return data + b"\x00" * (evtx.CHUNK_SIZE - len(data))


def test_evtx_carving(spark):
    when = 116444736000000000 + 1705286027 * 10_000_000
    full = _record(["EventID", "4625", "Computer", "ws01.lan", "TargetUserName", "bob smith", "IpAddress", "10.0.0.5",
                    "SubjectUserName", "LogonType", "3"], when)
    bare = _record(["EventID", "7045", "ServiceName", "my svc"], when)
    other = _record(["EventID", "9999"], when)
    folder = fresh()
    header = evtx.FILE_MAGIC + b"\x00" * (evtx.FILE_HEADER - 8)
    Path(folder, "Host7.EVTX").write_bytes(header + _chunk(full, other) + b"\x00" * evtx.CHUNK_SIZE + _chunk(bare))
    Path(folder, "bad.evtx").write_bytes(b"nothing" * 2000)
    Path(folder, "skip.txt").write_bytes(header + _chunk(full))
    rows = sorted(evtx.read_evtx(spark, folder, AS_OF).collect(), key=lambda r: r["raw_event_id"])
    assert [(r["raw_event_id"], r["computer"], r["target_user"], r["subject_user"], r["service_name"]) for r in rows] == [
        (4625, "ws01.lan", "bob smith", "", ""), (7045, "Host7", "", "", "my svc")]
    assert rows[0]["timestamp"] == datetime(2024, 1, 15, 2, 33, 47)
    done = n.normalise_windows(evtx.read_evtx(spark, folder, AS_OF)).filter("raw_event_id = 4625").first()
    assert done["actor"] == "bob smith@10.0.0.5"


def test_evtx_stream_follows_new_files(spark):
    folder = fresh()
    header = evtx.FILE_MAGIC + b"\x00" * (evtx.FILE_HEADER - 8)
    q = evtx.read_evtx(spark, folder, AS_OF, stream=True).writeStream.format("memory").queryName("carved").start()
    try:
        for i, name in enumerate(("a.evtx", "b.EVTX")):
            Path(folder, name).write_bytes(header + _chunk(_record(["EventID", "1102"], 0)))
            q.processAllAvailable()
            assert spark.table("carved").count() == i + 1
    finally:
        q.stop()


def test_rule_pack_loading():
    folder = Path(fresh())
    (folder / "a.yml").write_text("title: A\nid: a\ndetection: {selection: {EventID: 1}}")
    (folder / "b.yaml").write_text("- not\n- a rule")
    (folder / "c.yml").write_text("title: only")
    (folder / "d.yml").write_text("title: D\ndetection: {s: {Message|re: '('}, condition: s}")
    (folder / "e.yml").write_text("title: E\ndetection: {s: {EventID: 1}, condition: s | count() > 5}")
    (folder / "f.yml").write_text("title: [unclosed")
    (folder / "g.yml").write_text("title: A again\nid: a\nlevel: odd\ntags: [attack.T1070.001, attack.defense_evasion]\ndetection: {selection: {}}")
    pack = g.RulePack.load(str(folder))
    assert len(pack.rules) == 11 and len(pack.errors) == 5
    rule = pack.rules[-1]
    assert (rule.title, rule.severity, rule.technique, rule.tactic) == ("A again", "MEDIUM", "T1070.001", "defense-evasion")
    assert len(pack.without("a").rules) == 10


@pytest.mark.parametrize("detection,expected", [
    ("{s: {}, condition: s}", True),
    ("{s: {EventID: 5}, condition: not s}", True),
    ("{s: {Missing: null}, condition: s}", True),
    ("{s: {Missing: x}, condition: not s}", True),
    ("{s: {user: bob}, condition: s}", True),  # found in the payload only
    ("{s: {IpAddress|cidr: '2001:db8::/32'}, condition: s}", True),
    ("{s: {IpAddress|cidr: '10.0.0.0/8'}, condition: s}", False),
    ("{s: {IpAddress|cidr: [10.0.0.0/8, 'fe80::/10', '2001:db8:0:1::/64']}, condition: s}", True),
    ("{s: {Computer: 'WS[0-1]?'}, condition: s}", True),
    ("{a: {EventID: 4625}, b: {EventID: 1}, condition: a and not (b or nothing)}", True),
    ("{a1: {EventID: 4625}, a2: {EventID: 1}, condition: all of a*}", False),
    ("{a1: {EventID: 4625}, a2: {EventID: 1}, condition: 1 of a* and not 2 of them}", True),
    ("{a: {EventID: 1}, b: {EventID: 4625}, c: {EventID: 2}, condition: a and c or b}", True),
])
def test_rule_semantics(spark, make, detection, expected):
    ev = make([(0, "bob@2001:db8:0:1::7", "ws01", 4625)]).withColumn("raw_payload", F.lit("User=bob, x"))
    got = g.test_rule(ev, f"title: t\ndetection: {detection}").first()["matched"]
    assert got is expected


def test_large_pack_in_one_pass(events):
    pack = g.RulePack()
    for i in range(230):
        pack = pack.with_rule(f"id: r{i}\ntitle: r{i}\ndetection: {{s: {{Computer: host-{i % 20}}}, condition: s}}")
    got = g.sigma_match(events, pack).count()
    assert got == sum(events.filter(F.col("source") == f"host-{i}").count() * len(range(i, 230, 20)) for i in range(20))


def test_event_table(spark, events):
    folder = fresh() + "/events"
    tables.append_events(events.filter("severity < 7"), folder)
    tables.append_events(events, folder)
    assert spark.read.parquet(folder).count() == events.count()
    assert tables.scan_archive(spark, folder, "2024-01-05", "2024-01-06").count() == events.filter(
        "timestamp BETWEEN '2024-01-05' AND '2024-01-06'").count()


def test_archive_and_snapshot(spark, events):
    old, snap = fresh() + "/old", fresh() + "/snap"
    live = tables.archive_events(events, old, "2024-01-31", 10)
    assert live.count() + spark.read.parquet(old).count() == events.count()
    one = events.limit(3).select(F.col("event_id").alias("entity_id"), F.lit(1.0).alias("risk_score"))
    tables.save_snapshot(one, snap, "2024-01-01")
    tables.save_snapshot(one.withColumn("risk_score", F.lit(2.0)), snap, "2024-01-02")
    assert [r["risk_score"] for r in tables.load_snapshot(spark, snap).collect()] == [2.0] * 3


def test_dedup_limits_copies_before_the_shuffle(events):
    plan = tables.dedup_events(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_alerts_without_a_time_or_of_another_day_are_stored_once(spark, tmp_path):
    from tracewarden.sources.tables import append_alerts

    def batch(*rows):
        return spark.createDataFrame(rows, "alert_id string, event_id string, day string").selectExpr(
            "alert_id", "event_id", "CAST(day AS timestamp) AS timestamp")

    path = str(tmp_path / "alerts")
    append_alerts(batch(("a", "1", None), ("b", "2", "2024-01-02")), path)
    append_alerts(batch(("a", "1", None), ("b", "2", "2024-01-05"), ("c", "3", None), ("d", "4", "2024-01-05")), path)
    append_alerts(batch(("a", "1", None), ("c", "3", None)), path)
    got = sorted((r.alert_id, str(r.timestamp)[:10]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "None"), ("b", "2024-01-02"), ("c", "None"), ("d", "2024-01-05")]


def test_null_is_not_absent(spark):
    """A required field that is there but null is repaired; only one that is not there rejects the event."""
    lines = ['{"event_id":null,"timestamp":null,"platform":null,"source":null}', '{"event_id":"b","timestamp":"2024-01-01T00:00:00","platform":"linux"}']
    valid, bad = v.parse_event_json(spark.createDataFrame([(x,) for x in lines], "value string"), "2024-02-01")
    row = valid.collect()
    assert [(r["event_id"], str(r["timestamp"]), r["platform"], r["source"]) for r in row] == [(None, "2024-02-01 00:00:00", "unknown", "unknown")]
    assert [r["reason"] for r in bad.collect()] == ["missing required field: source"]
