"""Rule packs that change: a log of imports, disablings and enablings, and events matched with the version of their time.

The log is a table (configuration: one row per change). A version of a rule is valid from its change up to the next one of
that rule, so the same events give the same alerts whenever they are examined: a rule disabled on a day has no alerts
after it and keeps those before it, and a rule that is imported again matches later events as its new text says.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.operators.rule_index import indexed_matches
from tracewarden.operators.rule_tests import RuleError
from tracewarden.operators.sigma import Rule, RulePack, compile_rule, sigma_match
from tracewarden.session import reliable

CHANGE = "rule_id string, moment timestamp, action string, body string, file_path string, batch int, place int"
IMPORT, DISABLE, ENABLE = "import", "disable", "enable"


def imported(text: str, moment: str, file_path: str = "imported") -> tuple:
    """A change: the rule of this YAML text is in force from ``moment`` on; raises RuleError if it cannot be compiled."""
    return (compile_rule(yaml.safe_load(text), file_path).rule_id, moment, IMPORT, text, file_path)


def disabled(rule_id: str, moment: str) -> tuple:
    return (rule_id, moment, DISABLE, None, None)


def enabled(rule_id: str, moment: str) -> tuple:
    return (rule_id, moment, ENABLE, None, None)


def change_log(spark: SparkSession, changes: Iterable[tuple], batch: int = 0) -> DataFrame:
    """Changes as a table. Of changes of a rule at one moment the later batch counts, and in a batch the later place."""
    rows = [(*c, batch, place) for place, c in enumerate(changes)]
    text = spark.createDataFrame(rows, CHANGE.replace("moment timestamp", "moment string"))
    return text.withColumn("moment", F.col("moment").cast("timestamp"))


def append_changes(spark: SparkSession, path: str, changes: Iterable[tuple], batch: int) -> None:
    """Store changes as a batch of the log at ``path``; a repeated batch replaces itself."""
    change_log(spark, changes, batch).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(path)


def versions(changes: DataFrame) -> DataFrame:
    """(rule_id, version, valid_from, valid_to, is_active, body, file_path): one row per change that was ever in force.

    ``valid_to`` is null for the newest. A rule disabled or enabled before its first import has no version then; changes
    without a rule or a moment are left out.
    """
    w = Window.partitionBy("rule_id").orderBy("moment", "batch", "place")
    told = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        changes.filter("rule_id IS NOT NULL AND moment IS NOT NULL")
        .select(
            "rule_id", F.col("moment").alias("valid_from"), F.lead("moment").over(w).alias("valid_to"),
            (F.col("action") != DISABLE).alias("is_active"), F.last("body", True).over(told).alias("body"),
            F.last("file_path", True).over(told).alias("file_path"), "batch", "place",
        )
        .filter("body IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")
        .withColumn("version", F.row_number().over(Window.partitionBy("rule_id").orderBy("valid_from", "batch", "place")))
        .select("rule_id", "version", "valid_from", "valid_to", "is_active", "body", "file_path")
    )


@dataclass(frozen=True)
class RuleHistory:
    """Every version of every rule, compiled. Times are microseconds; ``until`` is None for the newest."""

    entries: tuple[tuple[Rule, int, int, int | None, bool], ...]  # rule, version, since, until, is_active

    @classmethod
    def of(cls, changes: DataFrame) -> RuleHistory:
        rows = versions(changes).orderBy("rule_id", "version").select(
            "body", "file_path", "version", F.unix_micros("valid_from").alias("since"), F.unix_micros("valid_to").alias("until"),
            "is_active", "rule_id").collect()  # configuration: one row per change
        entries = []
        for r in rows:
            rule = compile_rule(yaml.safe_load(r["body"]), r["file_path"])
            if rule.rule_id != r["rule_id"]:
                raise RuleError(f"the text stored for {r['rule_id']} is that of {rule.rule_id}")
            entries.append((rule, r["version"], r["since"], r["until"], r["is_active"]))
        return cls(tuple(entries))

    @property
    def pack(self) -> RulePack:
        """The versions that are not disabled, each as a rule of its own."""
        return RulePack(tuple(rule for rule, _, _, _, active in self.entries if active))

    def matches(self, events: DataFrame, pack: RulePack | None = None, by=indexed_matches) -> DataFrame:
        """As ``sigma.rule_matches`` of ``pack``, with the versions valid at the time of an event. No time, no version."""
        spans = [(n, since, until) for n, (since, until) in enumerate((s, u) for _, _, s, u, active in self.entries if active)]
        valid = events.sparkSession.createDataFrame(spans, "_rule int, _since bigint, _until bigint")
        at = F.unix_micros("timestamp")
        met = by(events, pack or self.pack).join(F.broadcast(valid), "_rule")
        return met.filter((at >= F.col("_since")) & (F.col("_until").isNull() | (at < F.col("_until")))).select(*events.columns, "_rule")

    def alerts(self, events: DataFrame, by=indexed_matches) -> DataFrame:
        """Candidate alerts of the versions valid at the time of each event."""
        return sigma_match(events, self.pack, lambda e, pack: self.matches(e, pack, by))

    def pack_at(self, as_of: str, spark: SparkSession) -> RulePack:
        """The pack in force at a moment, for operators that take one."""
        at = spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp"))).first()[0]
        return RulePack(tuple(rule for rule, _, since, until, active in self.entries if active and since <= at and (until is None or at < until)))

    def table(self, spark: SparkSession) -> DataFrame:
        """The versions as records. As records are updated by a new import, the description stays that of the first."""
        first = {}
        rows = []
        for rule, version, since, until, active in self.entries:
            about = first.setdefault(rule.rule_id, rule.description)
            rows.append((rule.rule_id, version, rule.title, about, rule.status, rule.level, list(rule.tags), rule.file_path, active, since, until))
        out = spark.createDataFrame(
            rows, "rule_id string, version int, title string, description string, status string, level string, tags array<string>, "
            "file_path string, is_active boolean, since bigint, until bigint")
        return out.withColumns({"valid_from": F.timestamp_micros("since"), "valid_to": F.timestamp_micros("until")}).drop("since", "until")


def list_rules(history: RuleHistory, alerts: DataFrame, as_of: str, active_only: bool = True) -> DataFrame:
    """The rules as of a moment, by level and title, with how often all their versions matched up to it and when last.

    ``loaded_at`` is when the valid version came into force.
    """
    at = F.lit(as_of).cast("timestamp")
    counts = alerts.filter((F.col("timestamp") <= at) & F.col("sigma_rule_id").isNotNull()).groupBy(
        F.col("sigma_rule_id").alias("rule_id")).agg(F.count("*").alias("match_count"), F.max("timestamp").alias("last_matched"))
    now = history.table(alerts.sparkSession).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    now = now.filter("is_active") if active_only else now
    counts = reliable(counts)  # a row per rule
    return now.join(counts, "rule_id", "left").select(
        "rule_id", "version", "title", "description", "status", "level", "tags", "file_path", "is_active",
        F.coalesce("match_count", F.lit(0)).alias("match_count"), "last_matched", F.col("valid_from").alias("loaded_at"),
    ).orderBy("level", "title", "rule_id")
