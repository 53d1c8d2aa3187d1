"""Sigma-style rules compiled to Spark Columns and evaluated in one pass over the events.

Rules are configuration: they are read and compiled on the driver; matching is a projection without Python.
"""

from __future__ import annotations

import ast
import ipaddress
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import fixed
from tracewarden.functions.text import payload_kv
from tracewarden.operators.correlate import CANDIDATE, STAGE, proof
from tracewarden.operators.rule_tests import TESTS, RuleError, check_regex, field_columns, wildcard_regex

BUILTIN = Path(__file__).parent.parent / "resources" / "builtin_rules.yml"
RULES_PER_COLUMN = 100
LOWERED = "_payload"  # lower(raw_payload), computed once per event


# ---- Fields and values ----

def compile_field(name: str) -> Column:
    """Text value of a rule field: mapped column, else event column, else ``name=value`` inside the payload."""
    return F.coalesce(*[F.col(c).cast("string") for c in field_columns(name)], payload_kv(F.col("raw_payload"), name))


def _lowered(name: str) -> Column:
    if fixed.SIGMA_FIELDS.get(name) == "raw_payload":
        return F.coalesce(F.col(LOWERED), F.lower(compile_field(name)))
    return F.lower(compile_field(name))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _cidr(name: str, text: str) -> Column:
    """Address after the last '@' inside a network; IPv4 stays in the JVM, IPv6 uses a vectorised helper."""
    try:
        net = ipaddress.ip_network(str(text), strict=False)
    except ValueError:
        return F.lit(False)
    address = F.element_at(F.split(compile_field(name), "@"), -1)
    if net.version == 4:
        octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
        pattern = "^" + r"\.".join([octet] * 4) + "$"
        number = reduce(lambda acc, i: acc * 256 + F.regexp_extract(address, pattern, i).try_cast("long"), range(1, 5), F.lit(0))
        inside = number.between(int(net.network_address), int(net.broadcast_address))
        return _sure(F.when(address.rlike(pattern), inside))
    low, high = int(net.network_address), int(net.broadcast_address)

    @F.pandas_udf("boolean")
    def in_network(addresses: pd.Series) -> pd.Series:
        def inside(a):
            try:
                ip = ipaddress.ip_address(a)
            except ValueError:
                return False
            return ip.version == 6 and low <= int(ip) <= high

        return addresses.map(inside)

    return _sure(F.when(address.contains(":"), in_network(F.coalesce(address, F.lit("")))))


def match_value(name: str, value, modifiers: Sequence[str]) -> Column:
    """One value of one field. Never null, so ``not`` is safe."""
    text = "null" if value is None else str(value)
    if "cidr" in modifiers:
        return _cidr(name, text)
    if "re" in modifiers:
        return _sure(compile_field(name).rlike("(?i)" + check_regex(text)))
    c, low = _lowered(name), text.lower()
    for modifier, test in (("contains", c.contains), ("startswith", c.startswith), ("endswith", c.endswith)):
        if modifier in modifiers:
            return _sure(test(low))
    if low == "null":
        return F.coalesce(c.isin("", "null"), F.lit(True))
    if "*" in low or "?" in low:
        return _sure(c.rlike(wildcard_regex(low)))
    return _sure(c == low)


class Columns:
    """What detections are compiled to. ``rule_index`` has another form of the same, whose tests are data."""

    all = staticmethod(_all)
    any = staticmethod(_any)
    value = staticmethod(match_value)

    def keyword(self, word: str) -> Column:
        return _sure(F.col(LOWERED).contains(word))

    def one_of(self, column: str, *values: str) -> Column:
        return _sure(F.lower(column).isin(*values))

    def negated(self, test: Column) -> Column:
        return ~test

    def at_least(self, need: int, tests: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, [t.cast("int") for t in tests]) >= need


COLUMNS = Columns()


def match_field(key: str, value, to=COLUMNS) -> Column:
    name, *modifiers = key.split("|")
    modifiers = [m.lower() for m in modifiers]
    tests = [to.value(name, v, modifiers) for v in (value if isinstance(value, list) else [value])]
    return to.all(tests) if "all" in modifiers else to.any(tests)


def compile_block(block, to=COLUMNS) -> Column:
    """A selection: fields are ANDed; a list of selections is ORed; anything else matches nothing."""
    if isinstance(block, dict):
        return to.all([match_field(k, v, to) for k, v in block.items()])
    if isinstance(block, list):
        return to.any([compile_block(b, to) for b in block if isinstance(b, dict)])
    return to.any([])


def compile_keywords(words, to=COLUMNS) -> Column:
    words = words if isinstance(words, list) else [words]
    return to.any([to.keyword(str(w).lower()) for w in words])


# ---- Conditions ----

_QUANTIFIER = re.compile(r"\b(\d+|all)\s+of\s+([\w*\-.]+)", re.I)


def compile_condition(text: str, detection: dict, to=COLUMNS) -> Column:
    """Condition text -> Column. ``not`` binds tighter than ``and`` than ``or``, exactly as in Python, so the
    condition is rewritten to a Python expression over block numbers and read with the standard library."""
    blocks = {k: v for k, v in detection.items() if k not in ("condition", "keywords", "timeframe")}
    if "|" in text:
        raise RuleError("aggregations in conditions are not supported; use a correlation rule")
    if "timeframe" in detection:
        raise RuleError("timeframe is not supported; use a correlation rule")
    leaves: list[Column] = []

    def leaf(c: Column) -> str:
        leaves.append(c)
        return f" _{len(leaves) - 1} "

    def quantified(m: re.Match) -> str:
        need, target = m.group(1).lower(), m.group(2)
        if target == "them":
            names = list(blocks)
        elif target.endswith("*"):
            names = [b for b in blocks if b.startswith(target[:-1])]
        else:
            names = [b for b in blocks if b == target]
        if not names:
            return leaf(to.any([]))
        hits = [compile_block(blocks[n], to) for n in names]
        return leaf(to.at_least(len(names) if need == "all" else int(need), hits))

    def named(m: re.Match) -> str:
        word = m.group(0)
        if re.fullmatch(r"_\d+", word) or word in ("(", ")"):
            return word
        if word.lower() in ("and", "or", "not"):
            return f" {word.lower()} "
        if word.upper() in ("TRUE", "FALSE"):
            return leaf(to.all([]) if word.upper() == "TRUE" else to.any([]))
        if word == "keywords":
            return leaf(compile_keywords(detection.get("keywords", []), to))
        return leaf(compile_block(blocks.get(word), to))

    text = _QUANTIFIER.sub(quantified, text)
    text = re.sub(r"[()]|[^\s()]+", named, text)

    def fold(node) -> Column:
        if isinstance(node, ast.BoolOp):
            return (to.all if isinstance(node.op, ast.And) else to.any)([fold(v) for v in node.values])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return to.negated(fold(node.operand))
        if isinstance(node, ast.Name):
            return leaves[int(node.id[1:])]
        raise RuleError("unsupported condition")

    try:
        return fold(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as ex:
        raise RuleError(f"cannot read condition: {ex.msg}") from ex


def compile_logsource(source: dict, to=COLUMNS) -> Column:
    """Cheap test of platform and type, placed before the condition."""
    product, category, service = (str(source.get(k) or "").lower() for k in ("product", "category", "service"))
    tests = []
    if product in ("windows", "linux"):
        tests.append(to.one_of("platform", product))
    if category in ("process_creation", "process_access"):
        tests.append(to.one_of("event_type", "process"))
    if category in ("network_connection", "network_traffic"):
        tests.append(to.one_of("event_type", "network"))
    if service in ("security", "system"):
        tests.append(to.one_of("platform", "windows"))
    if service in ("syslog", "auth"):
        tests.append(to.one_of("platform", "linux", "network"))
    return to.all(tests)


# ---- Rules and packs ----

@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    description: str
    status: str
    level: str
    tags: tuple[str, ...]
    file_path: str
    severity: str
    score: int
    technique: str
    tactic: str
    raw: dict = field(compare=False, repr=False)

    def compiled(self, to):
        """Log source and condition in the form of ``to``."""
        detection = self.raw["detection"]
        condition = compile_condition(str(detection.get("condition", "selection")).strip(), detection, to)
        return to.all([compile_logsource(self.raw.get("logsource") or {}, to), condition])

    @cached_property
    def condition(self) -> Column:
        return self.compiled(COLUMNS)


def compile_rule(raw, file_path: str = "imported") -> Rule:
    if not isinstance(raw, dict):
        raise RuleError("not a valid rule (expected a mapping)")
    if "title" not in raw or "detection" not in raw:
        raise RuleError("missing required fields: title and detection")
    detection = raw["detection"]
    if not isinstance(detection, dict):
        raise RuleError("detection must be a mapping")
    level = str(raw.get("level", "medium"))
    severity, score = fixed.SIGMA_LEVELS.get(level.lower(), fixed.SIGMA_LEVELS["medium"])
    technique = tactic = ""
    for tag in map(str, raw.get("tags") or []):
        found = re.fullmatch(r"attack\.(t\d{4}(?:\.\d{3})?)", tag, re.I)
        if found:
            technique = found.group(1).upper()
        elif tag.startswith("attack.") and not re.match(r"attack\.t\d", tag, re.I):
            tactic = tag[len("attack."):].replace("_", "-")
    rule = Rule(
        rule_id=str(raw.get("id") or "rule-" + re.sub(r"\W+", "-", str(raw["title"]).lower())),
        title=str(raw["title"]),
        description=str(raw.get("description") or f"Sigma rule matched: {raw['title']}"),
        status=str(raw.get("status", "experimental")),
        level=level,
        tags=tuple(map(str, raw.get("tags") or [])),
        file_path=file_path,
        severity=severity,
        score=score,
        technique=technique,
        tactic=tactic,
        raw=raw,
    )
    rule.compiled(TESTS)  # a rule that cannot be compiled fails here
    return rule


@dataclass(frozen=True)
class RulePack:
    """An immutable set of rules and the load failures beside it."""

    rules: tuple[Rule, ...] = ()
    errors: tuple[str, ...] = ()

    @classmethod
    def builtin(cls) -> RulePack:
        return cls(tuple(compile_rule(raw, "builtin") for raw in yaml.safe_load(BUILTIN.read_text())))

    @classmethod
    def load(cls, *folders: str) -> RulePack:
        """Built-in rules, then the given folders in order (default: none); a bad file is listed, not fatal."""
        pack = cls.builtin()
        for folder in folders:
            for path in sorted(p for p in Path(folder).rglob("*.y*ml") if p.is_file()):
                try:
                    pack = pack.with_rule(path.read_text(encoding="utf-8"), str(path))
                except (RuleError, yaml.YAMLError, UnicodeDecodeError) as ex:
                    pack = replace(pack, errors=(*pack.errors, f"{path.name}: {ex}"))
        return pack

    def with_rule(self, text: str, file_path: str = "imported") -> RulePack:
        """Add a rule from YAML text, replacing one of the same id."""
        rule = compile_rule(yaml.safe_load(text), file_path)
        return replace(self, rules=(*(r for r in self.rules if r.rule_id != rule.rule_id), rule))

    def without(self, rule_id: str) -> RulePack:
        return replace(self, rules=tuple(r for r in self.rules if r.rule_id != rule_id))

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a DataFrame; its size is that of the configuration."""
        rows = [
            (i, r.rule_id, r.title, r.description, r.status, r.level, list(r.tags), r.file_path, True, r.severity,
             r.score, r.technique, r.tactic)
            for i, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(
            rows,
            "number int, rule_id string, title string, description string, status string, level string, "
            "tags array<string>, file_path string, is_active boolean, severity string, severity_score int, "
            "technique string, tactic string",
        )

    def error_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e,) for e in self.errors], "error string")


def rule_matches(events: DataFrame, pack: RulePack) -> DataFrame:
    """The events that match, with ``_rule``: one row per (event, matching rule number). One pass over the events."""
    df = events.withColumn(LOWERED, F.lower("raw_payload"))
    rules = list(enumerate(pack.rules))
    groups = []
    for start in range(0, len(rules), RULES_PER_COLUMN):
        name = f"_m{start}"
        some = F.array(*[F.when(r.condition, F.lit(i)) for i, r in rules[start:start + RULES_PER_COLUMN]])
        df = df.withColumn(name, F.array_compact(some))
        groups.append(name)
    if not groups:
        return df.withColumn("_rule", F.lit(0)).filter(F.lit(False)).drop(LOWERED)
    return df.withColumn("_rule", F.explode(F.concat(*groups))).drop(LOWERED, *groups)


def sigma_match(events: DataFrame, pack: RulePack, matches=rule_matches) -> DataFrame:
    """Candidate alerts of every rule on every event. For packs of thousands of rules, ``matches`` is ``rule_index.indexed_matches``."""
    hits = matches(
        events.select("event_id", "timestamp", "platform", "source", "actor", "target", "event_type", "severity",
                      "raw_event_id", "description", "raw_payload", "mitre_technique", "mitre_tactic"), pack
    ).select("event_id", "timestamp", "source", "actor", "target", "_rule")
    rules = pack.table(events.sparkSession).withColumnRenamed("number", "_rule")
    joined = hits.join(F.broadcast(rules), "_rule")  # configuration: one row per rule
    return joined.select(
        (F.lit(STAGE["sigma"]) + F.col("_rule")).alias("stage"),
        F.concat(F.lit("sigma:"), "rule_id").alias("alert_type"), "severity", "severity_score", "title", "description",
        "actor", "target", F.col("source").alias("source_host"), "timestamp", "event_id",
        F.col("rule_id").alias("sigma_rule_id"), F.col("technique").alias("mitre_technique"),
        F.col("tactic").alias("mitre_tactic"),
        F.create_map(
            F.lit("sigma_rule_id"), "rule_id", F.lit("sigma_title"), "title", F.lit("sigma_status"), "status",
            F.lit("sigma_level"), "level", F.lit("sigma_tags"), F.array_join("tags", ","),
        ).alias("metadata"),
        proof("own", 0, True).alias("proof"),
    ).select(*CANDIDATE)


def test_rule(events: DataFrame, text: str) -> DataFrame:
    """Dry run: every event with whether the rule matches it."""
    rule = compile_rule(yaml.safe_load(text), "test")
    return events.withColumn(LOWERED, F.lower("raw_payload")).select(
        "event_id", "timestamp", rule.condition.alias("matched")
    )


test_rule.__test__ = False


def rule_stats(alerts: DataFrame, pack: RulePack) -> DataFrame:
    """Rules with their match count and last match, derived from alerts."""
    hits = alerts.filter("sigma_rule_id IS NOT NULL").groupBy(F.col("sigma_rule_id").alias("rule_id")).agg(
        F.count("*").alias("match_count"), F.max("timestamp").alias("last_matched")
    )
    rules = pack.table(alerts.sparkSession).drop("number", "severity", "severity_score", "technique", "tactic")
    return F.broadcast(rules).join(hits, "rule_id", "left").withColumn(
        "match_count", F.coalesce("match_count", F.lit(0))
    )


def rule_summary(alerts: DataFrame, pack: RulePack, top: int = 10) -> DataFrame:
    """(measure, name, count, last_matched): rules, load errors, rules by level, and the most matched rules."""
    stats = rule_stats(alerts, pack)
    never = F.lit(None).cast("timestamp")
    most = stats.filter("match_count > 0").orderBy(F.desc("match_count"), "rule_id").limit(top)
    errors = alerts.sparkSession.range(1).select(
        F.lit("load_errors").alias("measure"), F.lit("").alias("name"), F.lit(len(pack.errors)).cast("long").alias("count"),
        never.alias("last_matched"))
    return (
        stats.agg(F.count("*").alias("count"))
        .select(F.lit("total_rules").alias("measure"), F.lit("").alias("name"), "count", never.alias("last_matched"))
        .unionByName(errors)
        .unionByName(stats.groupBy("level").count().select(
            F.lit("level").alias("measure"), F.col("level").alias("name"), "count", never.alias("last_matched")))
        .unionByName(most.select(
            F.lit("top_matched").alias("measure"), F.col("rule_id").alias("name"),
            F.col("match_count").alias("count"), "last_matched"))
    )


def list_rules(pack: RulePack, spark: SparkSession, active_only: bool = True) -> DataFrame:
    rules = pack.table(spark).drop("number", "severity", "severity_score", "technique", "tactic")
    return (rules.filter("is_active") if active_only else rules).orderBy("level", "title")
