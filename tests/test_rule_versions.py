"""Versions of rules, beside a walk through the log in plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from tracewarden.operators import rule_versions as v
from tracewarden.operators.sigma import RuleError, rule_matches
from tracewarden.session import scratch_folder

START = datetime(2024, 1, 15, 12)
TEXT = "id: {0}\ntitle: {0} {1}\ndescription: {1}\nlevel: low\ndetection: {{sel: {{EventID: {1}}}, condition: sel}}"


def moment(second):
    return str(START + timedelta(seconds=second))


def matched(df):
    return sorted((r["sigma_rule_id"], r["title"], r["event_id"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_walking_the_log(spark, make, seed):
    rnd = random.Random(seed)
    changes, log = [], []
    for _ in range(40):
        rule, second = rnd.choice(["r1", "r2", "r3"]), rnd.randrange(0, 60)  # several changes fall on one second
        action, number = rnd.choice(["import", "import", "disable", "enable"]), rnd.choice([4624, 4625, 1102])
        log.append((second, len(log), rule, action, number))
        changes.append(v.imported(TEXT.format(rule, number), moment(second)) if action == "import"
                       else v.disabled(rule, moment(second)) if action == "disable" else v.enabled(rule, moment(second)))
    rows = [(second, "ann", "h", rnd.choice([4624, 4625, 1102])) for second in range(-3, 65)]
    want = []
    for i, (second, _, _, number) in enumerate(rows):
        state = {}
        for at, _, rule, action, text in sorted(log):
            if at > second:
                break
            old, _ = state.get(rule, (None, False))
            state[rule] = (text if action == "import" else old, action != "disable")
        want += [(rule, f"{rule} {text}", f"e{i:04d}") for rule, (text, active) in state.items() if active and text == number]
    history = v.RuleHistory.of(v.change_log(spark, changes))
    events = make(rows, START)
    assert matched(history.alerts(events)) == sorted(want)
    assert matched(history.alerts(events, rule_matches)) == sorted(want)
    middle = {r.title for r in history.pack_at(moment(30), spark).rules}
    assert {t for _, t, e in want if e == "e0033"} <= middle


def test_disabled_from_a_moment_on_and_again_in_force(spark, make):
    path = scratch_folder(spark)
    v.append_changes(spark, path, [v.imported(TEXT.format("r", 4624), moment(0)), v.disabled("r", moment(10))], 0)
    v.append_changes(spark, path, [v.enabled("r", moment(20)), v.imported(TEXT.format("r", 4625), moment(30)), v.disabled("never", moment(0))], 1)
    v.append_changes(spark, path, [v.enabled("r", moment(20)), v.imported(TEXT.format("r", 4625), moment(30)), v.disabled("never", moment(0))], 1)
    history = v.RuleHistory.of(v.read_changes(spark, path))
    events = make([(s, "ann", "h", 4624) for s in (-1, 0, 9, 10, 19, 20, 29, 30)] + [(30, "ann", "h", 4625)], START)
    alerts = history.alerts(events)
    assert [e for _, _, e in matched(alerts)] == ["e0001", "e0002", "e0005", "e0006", "e0008"]
    one = lambda second, every=False: [
        (r["title"], r["description"], r["is_active"], r["match_count"]) for r in v.list_rules(history, alerts, moment(second), not every).collect()]
    assert one(15) == [] and one(15, True) == [("r 4624", "4624", False, 2)]
    assert one(25) == [("r 4624", "4624", True, 3)]
    assert one(40) == [("r 4625", "4624", True, 5)]  # a record keeps its first description
    assert one(-5, True) == []


def test_null_times_bad_rules_and_empty_logs(spark, make):
    events = make([(5, "ann", "h", 4624)], START)
    empty = v.RuleHistory.of(v.change_log(spark, []))
    assert empty.alerts(events).count() == 0 and v.list_rules(empty, empty.alerts(events), moment(9)).count() == 0
    history = v.RuleHistory.of(v.change_log(spark, [v.imported(TEXT.format("r", 4624), moment(0)), v.disabled("r", None), v.disabled(None, moment(1))]))
    assert history.alerts(events).count() == 1
    timeless = events.selectExpr(*["CAST(NULL AS TIMESTAMP) AS timestamp" if c == "timestamp" else c for c in events.columns])
    assert history.alerts(timeless).count() == 0
    with pytest.raises(RuleError):
        v.imported("title: x\ndetection: {sel: {a: 1}, condition: sel | count() > 3}", moment(0))
    with pytest.raises(RuleError):
        v.RuleHistory.of(v.change_log(spark, [("other", moment(0), "import", TEXT.format("r", 1), "f")]))
