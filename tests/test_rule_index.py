"""The rule index beside compiled Columns: the same rows, with fewer rules asked."""

import random

import pytest
import yaml
from pyspark.sql import functions as F

from tracewarden.operators import sigma
from tracewarden.operators.rule_index import RuleIndex, indexed_matches, proposed
from tracewarden.operators.rule_tests import TESTS, clauses
from tracewarden.plans import catalog


def pack_of(*rules):
    pack = sigma.RulePack()
    for i, (source, detection) in enumerate(rules):
        pack = pack.with_rule(yaml.safe_dump({"id": f"r{i}", "title": f"r{i}", "logsource": source, "detection": detection}))
    return pack


def rows(df):
    return sorted((r["event_id"] or "", r["_rule"]) for r in df.select("event_id", "_rule").collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Events with nulls, key=value payloads, Unicode case and empty texts."""
    payloads = ["", None, "cmd=whoami user=Bob", "CMD: WhoAmI, x", "image=C:\\Temp\\mimikatz.exe", "STRASSE Straße ΣΑΣ", "null", "port=443 | k=v"]
    events = []
    for i, payload in enumerate(payloads * 3):
        events.append((f"e{i}", None if i % 7 == 0 else ["windows", "Linux", None][i % 3], ["h1", "H2", None][i % 3], ["ann", "10.0.0.9", None, ""][i % 4],
                       ["auth", "PROCESS", None][i % 3], [4624, 4625, None][i % 3], ["Logon", None][i % 2], payload))
    df = spark.createDataFrame(events, "event_id string, platform string, source string, actor string, event_type string, raw_event_id int, description string, raw_payload string")
    return df.withColumns({"timestamp": F.lit("2024-01-01").cast("timestamp"), "target": F.lit(None).cast("string"), "severity": F.lit(1),
                           "mitre_technique": F.lit(""), "mitre_tactic": F.lit("")})


FIELDS = ["EventID", "Computer", "SubjectUserName", "Description", "CommandLine", "cmd", "user", "port", "event_type", "description", "event_id", "x.y(z"]
VALUES = [4624, "h2", "H1", "ann", "whoami", "*ami", "w?oami", "mimikatz", "443", "", None, "log*", "bob", "*\\temp\\*", "straße", "σασ", "e1*", "[a-w]*"]


def random_rule(rnd):
    def block():
        out = {}
        for _ in range(rnd.randrange(1, 4)):
            name = rnd.choice(FIELDS) + rnd.choice(["", "", "", "|contains", "|startswith", "|endswith", "|contains|all"])
            out[name] = rnd.choice([rnd.choice(VALUES), [rnd.choice(VALUES) for _ in range(2)]])
        return out if rnd.random() < 0.8 else [out, {"EventID": 4625}]

    detection = {"a1": block(), "a2": block(), "b": block(), "keywords": ["WhoAmI", "straSSE"]}
    detection["condition"] = rnd.choice([
        "a1", "a1 and not b", "1 of a*", "all of a*", "2 of them", "not a1", "a1 or b", "keywords", "keywords and not 1 of a*",
        "(a1 or a2) and not (b and a1)", "all of them", "TRUE", "not keywords or FALSE", "missing or a2", "1 of nothing*", "0 of a*"])
    source = rnd.choice([{}, {"product": "windows"}, {"service": "auth"}, {"category": "process_creation"}, {"product": "linux", "service": "syslog"}])
    return source, detection


@pytest.mark.parametrize("seed", range(3))
def test_same_rows_as_compiled_columns(odd, seed):
    rnd = random.Random(seed)
    pack = pack_of(*[random_rule(rnd) for _ in range(60)])
    assert rows(indexed_matches(odd, pack)) == rows(sigma.rule_matches(odd, pack))


def test_modifiers_networks_and_builtin(events):
    pack = catalog._custom_pack()
    for rule in sigma.RulePack.builtin().rules:
        pack = sigma.RulePack((*pack.rules, rule))
    assert RuleIndex.of(pack).compiled  # a network and "2 of them"
    assert rows(indexed_matches(events, pack)) == rows(sigma.rule_matches(events, pack))


def test_work_follows_the_rules_that_match(spark, odd):
    """5,000 rules: an event meets those of its own value or text, not all."""
    rules = [({}, {"sel": {"EventID": 10_000 + i}, "condition": "sel"}) for i in range(2_500)]
    rules += [({}, {"sel": {"CommandLine|contains": f"tool-{i:05d}"}, "condition": "sel"}) for i in range(2_500)]
    rules += [({}, {"sel": {"EventID": 4625}, "condition": "sel"}), ({}, {"sel": {"Image|endswith": "mimikatz.exe"}, "condition": "sel"})]
    pack = sigma.RulePack(tuple(sigma.compile_rule({"title": f"r{i}", "logsource": s, "detection": d}) for i, (s, d) in enumerate(rules)))
    index = RuleIndex.of(pack)
    assert not index.always and not index.compiled
    asked, found = proposed(odd, index).count(), rows(indexed_matches(odd, pack))
    assert asked == len(found) == odd.filter("raw_event_id = 4625").count() + odd.filter("raw_payload LIKE '%mimikatz.exe'").count()


def test_filing():
    def filed(detection, source=None):
        pack = pack_of((source or {}, detection))
        index = RuleIndex.of(pack)
        return dict(index.texts), {k: dict(v) for k, v in index.values.items()}, index.always, index.compiled

    one = lambda sel, condition="sel": {"sel": sel, "condition": condition}
    assert filed(one({"EventID": 1, "Message|contains": "mimikatz"}))[0] == {"mimikatz": [0]}
    assert filed(one({"EventID": [1, 2], "Message|contains": "abc"}))[1] == {(("raw_event_id",), "EventID"): {"1": [0], "2": [0]}}
    assert filed(one({"EventID": 1}, "not sel"))[2] == [0]
    assert filed(one({"Message|contains": "Straße"}))[2] == [0]  # lower case of a part is safe for ASCII only
    assert filed(one({"IpAddress|cidr": "10.0.0.0/8"}))[3] == [0]
    assert filed({"condition": "none"}) == ({}, {}, [], [])  # never matches
    assert filed(one({"NoField": None}), {"product": "windows"})[1] == {(("platform",), None): {"windows": [0]}}


def test_clauses_are_bounded():
    wide = {f"s{i}": {"EventID": i, "Computer": f"h{i}"} for i in range(10)}
    assert clauses(sigma.compile_condition("1 of s*", {**wide, "condition": ""}, TESTS)) is None


def test_empty_pack_and_events(odd):
    assert indexed_matches(odd, sigma.RulePack()).count() == 0
    assert indexed_matches(odd.limit(0), sigma.RulePack.builtin()).count() == 0
