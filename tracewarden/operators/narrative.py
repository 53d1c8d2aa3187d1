"""Who, what, where, when, why and how of every alert: projections plus one join with the small template table."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.text import blank, or_unknown
from tracewarden.functions.times import instant

TEXTS = Path(__file__).parent.parent / "resources" / "narratives.yml"


def templates(spark: SparkSession) -> DataFrame:
    """template, what, why, commands, remediation: one row per alert type and one default."""
    rows = [(k, t["what"], t["why"], t["commands"], t["remediation"]) for k, t in yaml.safe_load(TEXTS.read_text()).items()]
    return spark.createDataFrame(
        rows, "template string, what string, why string, commands array<string>, remediation array<string>")


def template_names(spark: SparkSession) -> DataFrame:
    return templates(spark).filter("template != 'default'").select("template").orderBy("template")


def who(actor: Column, target: Column) -> Column:
    parts = F.split(actor, "@", -1)
    at = actor.contains("@")
    address = actor.rlike("[0-9]") & actor.contains(".")
    kind = (
        F.when(at, "user with source IP").when(address, "IP address").when(actor.endswith("$"), "computer account")
        .otherwise("user account")
    )
    return F.struct(
        actor.alias("actor"),
        F.when(at, F.get(parts, F.lit(0))).otherwise(actor).alias("actor_name"),
        kind.alias("actor_type"),
        F.when(at, F.get(parts, F.lit(1))).when(address, actor).otherwise("unknown").alias("source_ip"),
        target.alias("target"),
        F.concat(F.initcap(kind), F.lit(": "), actor).alias("summary"),
    )


def where(source_host: Column, target: Column, hosts: Column) -> Column:
    hosts = F.coalesce(hosts, F.array(source_host))
    n = F.size(hosts)
    return F.struct(
        source_host.alias("source_host"), target.alias("target"), hosts.alias("affected_hosts"), n.alias("host_count"),
        F.when(n <= 1, F.concat(F.lit("Host: "), source_host))
        .otherwise(F.concat(n, F.lit(" hosts: "), F.array_join(F.slice(hosts, 1, 3), ", "))).alias("summary"),
    )


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n))


def relative_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds, F.lit(" seconds ago")))
        .when(seconds < 3600, F.concat(_div(seconds, 60), F.lit(" minutes ago")))
        .when(seconds < 86400, F.concat(_div(seconds, 3600), F.lit(" hours ago")))
        .otherwise(F.concat(_div(seconds, 86400), F.lit(" days ago")))
    )


def span_text(seconds: Column) -> Column:
    """Length of an attack, null when it has none."""
    return F.when(
        seconds > 0,
        F.when(seconds < 60, F.concat(seconds, F.lit("s")))
        .when(seconds < 3600, F.concat(_div(seconds, 60), F.lit("m "), seconds % 60, F.lit("s")))
        .otherwise(F.concat(_div(seconds, 3600), F.lit("h "), _div(seconds % 3600, 60), F.lit("m"))),
    )


def when(ts: Column, span: Column, as_of, night_start: int = 18, night_end: int = 7) -> Column:
    age = _div(F.unix_micros(instant(as_of)) - F.unix_micros(ts), 1_000_000)
    hour = F.hour(ts)
    clock = F.date_format(ts, "HH:mm:ss")
    relative, attack = relative_text(age), span_text(span)
    return F.struct(
        ts.alias("timestamp"), relative.alias("relative"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'").alias("utc_formatted"), hour.alias("hour"),
        ((hour >= night_start) | (hour < night_end)).alias("is_after_hours"), attack.alias("attack_span"),
        F.concat(clock, F.lit(" UTC ("), relative, F.lit(")"),
                 F.coalesce(F.concat(F.lit(" - span: "), attack), F.lit(""))).alias("summary"),
    )


def why(text: Column, description: Column, meta: Column, technique: Column, tactic: Column, rule: Column) -> Column:
    labels = {
        "failure_count": "Failure count", "threshold": "Detection threshold", "host_count": "Hosts involved",
        "login_count": "Related logins",
    }
    facts = F.array(*[F.concat(F.lit(f"{label}: "), F.element_at(meta, key)) for key, label in labels.items()])
    known = ~blank(technique)
    return F.struct(
        text.alias("explanation"), description.alias("detection_detail"), F.array_compact(facts).alias("specifics"),
        technique.alias("mitre_technique"), tactic.alias("mitre_tactic"), rule.alias("sigma_rule_id"),
        F.when(known, F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(technique, F.lit("."), F.lit("/")),
                               F.lit("/"))).alias("mitre_url"),
        F.when(~blank(rule), F.concat(F.lit("Rule: "), rule))
        .when(known, F.concat(F.lit("MITRE "), technique)).otherwise("Correlation rule match").alias("summary"),
    )


def filled(text: Column, actor: Column, source_host: Column, target: Column, meta: Column) -> Column:
    """A template text with its placeholders replaced, from the alert and then from its metadata."""
    ip = F.element_at(F.split(actor, "@"), -1)
    for name, value in (("actor", actor), ("source_host", source_host), ("source_ip", ip), ("target", target)):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("unknown")))
    return F.aggregate(
        F.map_entries(F.coalesce(meta, F.create_map().cast("map<string,string>"))), text,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def how(done: Column, remediation: Column, steps: Column) -> Column:
    """From the filled commands and numbered steps, and the steps of the template."""
    def is_windows(c: Column) -> Column:
        return c.contains("Get-") | c.contains("sc.exe") | F.lower(c).contains("net ")

    def is_linux(c: Column) -> Column:
        return c.contains("grep") | c.contains("/var/log") | c.contains("journalctl")

    runnable = F.size(F.filter(done, lambda c: (F.trim(c) != "") & ~c.startswith("#")))
    return F.struct(
        done.alias("investigation_commands"),
        F.filter(done, is_windows).alias("windows_commands"),
        F.filter(done, is_linux).alias("linux_commands"),
        F.filter(done, lambda c: ~is_windows(c) & ~is_linux(c)).alias("general_commands"),
        remediation.alias("remediation_steps"), runnable.alias("command_count"),
        F.concat(F.size(steps), F.lit(" remediation steps, "), runnable, F.lit(" commands")).alias("summary"),
    )


# Between the texts of a template while they are filled as one.
_MARK = "\u0001"


def _filled_texts(rows: DataFrame, *parts: Column) -> DataFrame:
    """Add ``_texts``: what, why, the commands and the numbered steps of the template in ``_all``, filled.

    All texts are filled in one pass over ``_all``. Where a value holds the mark, or a text is missing, each is filled by itself.
    """
    rows = rows.withColumn("_filled", filled(F.col("_all"), *parts))
    *names, meta = parts
    values = F.concat_ws("", *names, F.map_values(F.coalesce(meta, F.create_map().cast("map<string,string>"))))
    return rows.withColumn("_texts", F.when(
        F.col("_filled").isNotNull() & ~values.contains(_MARK), F.split("_filled", _MARK, -1),
    ).otherwise(F.transform("_each", lambda text: filled(text, *parts))))


def _told(alerts: DataFrame, as_of, texts: DataFrame | None) -> tuple[DataFrame, Column]:
    """Alerts with the texts of their templates, and the narrative as a column over them."""
    texts = templates(alerts.sparkSession) if texts is None else texts
    none = F.array().cast("array<string>")
    steps = F.transform("remediation", lambda step, i: F.concat((i + 1).cast("string"), F.lit(". "), step))
    texts = texts.withColumn("_each", F.concat(F.array("what", "why"), F.coalesce("commands", none), F.coalesce(steps, none)))
    whole = F.forall("_each", lambda text: text.isNotNull() & ~text.contains(_MARK))
    texts = texts.select(
        "template", "_each", F.when(whole, F.array_join("_each", _MARK)).alias("_all"), F.size("commands").alias("_commands"),
        F.col("commands").isNotNull().alias("_has_commands"), "remediation")
    # Template tables have one row per alert type; they are configuration.
    own = texts.filter("template != 'default'").select(F.col("template").alias("alert_type"), F.col("template").alias("_own"))
    joined = alerts.join(F.broadcast(own), "alert_type", "left").withColumn("template", F.coalesce("_own", F.lit("default")))
    joined = joined.join(F.broadcast(texts), "template", "left")
    target, meta = or_unknown(F.col("target")), F.col("metadata")
    joined = _filled_texts(joined, F.col("actor"), F.col("source_host"), target, meta)
    hosts = F.col("distinct_hosts") if "distinct_hosts" in alerts.columns else F.lit(None).cast("array<string>")
    span = F.element_at(meta, F.lit("span_seconds")).try_cast("long")
    told = F.col("_texts")
    commands = F.when(F.col("_has_commands"), F.slice(told, F.lit(3), F.col("_commands")))
    steps = F.when(F.col("remediation").isNotNull(), F.slice(
        told, F.lit(3) + F.greatest(F.col("_commands"), F.lit(0)), F.greatest(F.size("remediation"), F.lit(0))))
    return joined, F.struct(
        who(F.col("actor"), target).alias("who"),
        F.get(told, F.lit(0)).alias("what"),
        where(F.col("source_host"), target, hosts).alias("where"),
        when(F.col("timestamp"), span, as_of).alias("when"),
        why(F.get(told, F.lit(1)), F.col("description"), meta, F.col("mitre_technique"), F.col("mitre_tactic"),
            F.col("sigma_rule_id")).alias("why"),
        how(commands, steps, F.col("remediation")).alias("how"),
    )


def five_w(alerts: DataFrame, as_of, texts: DataFrame | None = None) -> DataFrame:
    """Add ``five_w`` to final alerts; rule alerts and unknown types take the default template."""
    joined, story = _told(alerts, as_of, texts)
    return joined.withColumn("five_w", story).drop(
        "template", "_own", "_each", "_all", "_commands", "_has_commands", "remediation", "_filled", "_texts")


def five_w_fields(alerts: DataFrame, as_of, fields: Mapping[str, str], texts: DataFrame | None = None) -> DataFrame:
    """Add single fields of ``five_w`` under names of their own, as {"place": "where.summary"}; those not named are not made.

    Spark computes a struct as a whole, so fields picked from ``five_w`` cost all of it.
    """
    joined, story = _told(alerts, as_of, texts)
    picked = []
    for name, path in fields.items():
        field = story
        for part in path.split("."):
            field = field[part]
        picked.append(field.alias(name))
    return joined.select(*alerts.columns, *picked)
