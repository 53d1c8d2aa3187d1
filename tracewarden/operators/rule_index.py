"""Matching events with thousands of rules: an index proposes rules for an event, and only those are tested.

``sigma.rule_matches`` asks every rule about every event, in one projection that grows with the pack. Here the rules are a
table. Each is filed under what it cannot match without:

* a text that the payload must contain (all texts are searched for in one pass over the payload, by one automaton), or
* a value that a field must have (one lookup per field that is filed under), or
* nothing, if it has neither; such rules are proposed for every event.

The clauses of the proposed rules are then evaluated as data, so the plan is the same for ten rules and for ten thousand.
Rules whose conditions are no clauses (networks, ``2 of them``, very wide conditions) go through compiled Columns.
The index is configuration, broadcast to the executors; its size is that of the pack.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.rule_tests import TESTS, Clause, Test, clauses, wildcard_regex
from tracewarden.operators.sigma import LOWERED, RulePack, compile_field, rule_matches
from tracewarden.schema import EVENT_COLUMNS

CLAUSES = "array<array<struct<negated boolean, a int, b int, key string, op string, text string>>>"
# Fields with a handful of values: worth filing under only when a rule has nothing better.
COARSE = ("platform", "event_type")


@dataclass
class RuleIndex:
    """Where each rule of a pack is filed. Rules are numbers: their places in the pack."""

    programs: dict[int, list[Clause]] = field(default_factory=dict)
    texts: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    values: dict[tuple, dict[str, list[int]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))
    always: list[int] = field(default_factory=list)
    compiled: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, pack: RulePack) -> RuleIndex:
        index = cls()
        for number, rule in enumerate(pack.rules):
            program = clauses(rule.compiled(TESTS))
            if program is None:
                index.compiled.append(number)
            elif all(program):  # a clause without tests never holds
                index.programs[number] = program
                index._file(number, program)
        return index

    def _file(self, number: int, program: list[Clause]) -> None:
        kind, keys = max((a for c in program if (a := _anchor(c)) is not None), key=_worth, default=(None, ()))
        if kind is None:
            self.always.append(number)
        for key in keys:
            (self.texts if kind == "text" else self.values[kind])[key].append(number)


def _anchor(clause: Clause):
    """("text", texts) or (field, values) of which one is needed for the clause to hold, or None."""
    if any(negated for _, negated in clause):
        return None
    texts = [t.literal() for t, _ in clause]
    if all(texts):
        return "text", set(texts)
    fields = {(t.columns, t.name) for t, _ in clause}
    if len(fields) == 1 and all(t.op == "eq" for t, _ in clause):
        return fields.pop(), {t.text for t, _ in clause}
    return None


def _worth(anchor) -> tuple:
    """The rarest is best: long texts, then values, then short texts, then values of coarse fields; then fewer of them."""
    kind, keys = anchor
    if kind == "text":
        return (3 if min(map(len, keys)) >= 6 else 1, min(map(len, keys)), -len(keys))
    return (0 if kind[0][:1] and kind[0][0] in COARSE else 2, 0, -len(keys))


def _texts_found(texts: dict[str, list[int]]):
    """A column function: the rules filed under the texts that a payload contains, in one pass over it."""
    filed = {text: tuple(numbers) for text, numbers in texts.items()}

    @F.pandas_udf("array<int>")
    def found(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, numbers in filed.items():
            automaton.add_word(text, numbers)
        automaton.make_automaton()
        for batch in payloads:
            yield batch.map(lambda p: sorted({n for _, numbers in automaton.iter(p) for n in numbers}) if p else [])

    return found


def _lookup(kind: tuple) -> Column:
    columns, name = kind
    if name is None:  # a column of the log source
        return F.lower(columns[0])
    return F.lower(compile_field(name))


def proposed(events: DataFrame, index: RuleIndex) -> DataFrame:
    """One row per event and rule that the index proposes, as ``_rule``; ``_payload`` is the payload in lower case."""
    spark = events.sparkSession
    df = events.withColumn(LOWERED, F.lower("raw_payload"))
    none = F.array().cast("array<int>")
    lists = [F.array(*map(F.lit, index.always)).cast("array<int>")] if index.always else []
    if index.texts:
        lists.append(_texts_found(index.texts)(F.col(LOWERED)))
    for i, (kind, values) in enumerate(index.values.items()):
        # One row per value, so no event becomes two.
        table = spark.createDataFrame([(k, n) for k, n in values.items()], f"_value{i} string, _rules{i} array<int>")
        df = df.join(F.broadcast(table), _lookup(kind) == F.col(f"_value{i}"), "left")
        lists.append(F.coalesce(f"_rules{i}", none))
    some = F.concat(*lists) if lists else none
    return df.select(*events.columns, LOWERED, F.explode(some).alias("_rule"))


def _row(test: Test, negated: bool) -> tuple:
    """A test as data: the places of its columns, -1 for none, and the pattern that finds its name in the payload."""
    a, b = (*[EVENT_COLUMNS.index(c) for c in test.columns], -1, -1)[:2]
    key = None if test.name is None else "(?i)" + re.escape(test.name) + r"[=:\s]+([^\s,|]+)"
    text = wildcard_regex(test.text) if test.op == "like" else test.text
    return (negated, a, b, key, test.op, text)


def _holds(t: Column) -> Column:
    """Whether one test holds; null-free."""
    in_payload = F.nullif(F.call_function("regexp_extract", F.coalesce("raw_payload", F.lit("")), t["key"], F.lit(1)), F.lit(""))
    low = F.coalesce(F.get("_lows", t["a"]), F.get("_lows", t["b"]), F.lower(in_payload))
    exact = F.coalesce(F.get("_vals", t["a"]), F.get("_vals", t["b"]), in_payload)
    text, op = t["text"], t["op"]
    holds = (
        F.when(op == "eq", low == text).when(op == "contains", F.contains(low, text))
        .when(op == "starts", F.startswith(low, text)).when(op == "ends", F.endswith(low, text))
        .when(op == "like", F.rlike(low, text)).when(op == "re", F.rlike(exact, text))
        .when(op == "null", F.coalesce(low.isin("", "null"), F.lit(True)))
    )
    return F.coalesce(holds, F.lit(False))


def indexed_matches(events: DataFrame, pack: RulePack) -> DataFrame:
    """The rows of ``sigma.rule_matches``: the events that match, one row per (event, matching rule number) as ``_rule``."""
    spark, index = events.sparkSession, RuleIndex.of(pack)
    columns = [F.col(c).cast("string") if c in events.columns else F.lit(None).cast("string") for c in EVENT_COLUMNS]
    lows = [F.col(LOWERED) if n == "raw_payload" else F.lower(c) for n, c in zip(EVENT_COLUMNS, columns)]
    rows = [(n, [[_row(t, negated) for t, negated in c] for c in program]) for n, program in index.programs.items()]
    programs = spark.createDataFrame(rows, f"_rule int, _clauses {CLAUSES}")
    asked = proposed(events, index).join(F.broadcast(programs), "_rule").withColumns(
        {"_vals": F.array(*columns), "_lows": F.array(*lows)})
    passed = F.forall("_clauses", lambda c: F.exists(c, lambda t: t["negated"] != _holds(t)))
    out = asked.filter(passed).select(*events.columns, "_rule")
    if not index.compiled:
        return out
    rest = rule_matches(events, RulePack(tuple(pack.rules[n] for n in index.compiled)))
    number = F.get(F.array(*map(F.lit, index.compiled)), F.col("_rule"))
    return out.unionByName(rest.withColumn("_rule", number))
