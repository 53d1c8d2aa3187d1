"""Raw Windows, Linux and network records -> flat events. Projections only: the same code runs batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import fixed
from tracewarden.functions.text import (
    blank, clean_text, contains_any, content_id, dst_of, forwarded_id, iptables_text, looks_like_ip, or_unknown,
    pfsense_text, strip, syslog_severity, truncate_text,
)
from tracewarden.functions.times import ISO_STAMP, SYSLOG_STAMP, after_syslog_ts, instant, iso_ts, syslog_ts
from tracewarden.schema import EVENT_COLUMNS


def _events(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Event columns in order, then any columns of the source worth keeping (file, offset, ...)."""
    ints = ("severity", "raw_event_id")
    return df.select(*[F.col(c).cast("int") if c in ints else F.col(c) for c in EVENT_COLUMNS], *keep)


# ---- Windows ----

def windows_type(c: Column) -> Column:
    """Event type of a Windows event id."""
    out = None
    for low, high, name in fixed.WINDOWS_TYPES:
        out = F.when(c.between(low, high), name) if out is None else out.when(c.between(low, high), name)
    return out.otherwise("system")


def windows_lookup(c: Column) -> Column:
    """(description, severity, technique, tactic) of a known Windows event id, else null."""
    entries = []
    for number, (text, severity, technique, tactic) in fixed.WINDOWS_EVENTS.items():
        entries += [F.lit(number), F.struct(
            F.lit(text).alias("description"), F.lit(severity).alias("severity"),
            F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"),
        )]
    return F.try_element_at(F.create_map(*entries), c)


def normalise_windows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Windows records (schema.WINDOWS_RAW) -> events."""
    known = F.col("_known")
    user = F.when(
        ~blank(F.col("target_user")) & (F.col("target_user") != "-"), F.col("target_user")
    ).otherwise(F.coalesce("subject_user", F.lit("")))
    ip = F.col("ip_address")
    with_ip = ~blank(ip) & ~ip.isin("-", "::1")
    service = ~blank(F.col("service_name"))
    text = F.coalesce(known["description"], F.lit(""))
    text = F.when(service, F.concat(text, F.lit(": "), F.col("service_name"))).otherwise(text)
    out = df.withColumn("_known", windows_lookup(F.col("raw_event_id"))).select(
        content_id(F.col("computer"), F.col("raw_event_id"), F.col("timestamp"), F.col("raw_payload")).alias("event_id"),
        "timestamp",
        F.lit("windows").alias("platform"),
        or_unknown(F.col("computer")).alias("source"),
        clean_text(F.when(with_ip, F.concat(user, F.lit("@"), ip)).otherwise(user)).alias("actor"),
        F.when(service, clean_text(F.col("service_name")))
        .when(~blank(F.col("process_name")), clean_text(F.col("process_name")))
        .otherwise(clean_text(F.col("computer"))).alias("target"),
        windows_type(F.col("raw_event_id")).alias("event_type"),
        F.coalesce(known["severity"], F.lit(2)).alias("severity"),
        "raw_event_id",
        F.when(text == "", F.concat(F.lit("Windows Event ID "), F.col("raw_event_id"))).otherwise(text)
        .alias("description"),
        F.coalesce(known["technique"], F.lit("")).alias("mitre_technique"),
        F.coalesce(known["tactic"], F.lit("")).alias("mitre_tactic"),
        F.coalesce("raw_payload", F.lit("")).alias("raw_payload"), *keep,
    )
    return _events(out, keep)


# ---- Linux ----

def is_noise(c: Column) -> Column:
    return contains_any(F.lower(c), fixed.NOISE_PATTERNS)


def parse_linux_lines(df: DataFrame, year: int, as_of, col: str = "value") -> DataFrame:
    """Log lines -> (timestamp, process, pid, message) beside the other columns; blank lines are dropped."""
    line = F.col("_line")
    stamp = syslog_ts(line, year)
    df = df.withColumn("_line", strip(F.col(col))).filter("_line != ''")
    df = df.withColumn("_ts", stamp).withColumn(
        "_words",
        F.filter(F.split(F.when(F.col("_ts").isNull(), line).otherwise(after_syslog_ts(line)), r"\s+"), lambda w: w != ""),
    )
    words = F.col("_words")
    # The first word is the host unless it already looks like "process:".
    start = F.when((F.size(words) > 1) & ~F.get(words, F.lit(0)).contains(":"), 1).otherwise(0)
    df = df.withColumn("_start", start).withColumn("_proc", F.regexp_replace(F.get(words, F.col("_start")), ":$", ""))
    rest = F.slice(words, F.col("_start") + 2, F.size(words))
    return df.withColumns({
        "timestamp": F.coalesce("_ts", instant(as_of)),
        "process": F.coalesce(F.element_at(F.split("_proc", r"\["), 1), F.lit("unknown")),
        "pid": F.nullif(F.regexp_extract("_proc", r"\[([^\]]*)\]", 1), F.lit("")),
        "message": F.when(F.size(rest) > 0, F.array_join(rest, " ")).otherwise(line),
    }).drop("_line", "_ts", "_words", "_start", "_proc")


def linux_actors(message: Column, process: Column, strict: bool = False) -> tuple[Column, Column]:
    """(actor, target) named in a message, null where none. ``strict`` reads only the ``for user X`` form."""
    actor = F.nullif(F.regexp_extract(message, r"for user\s+(\S+)", 1), F.lit(""))
    if not strict:
        ssh = F.regexp_extract(message, r"\bfor (?:invalid user )?(\S+) from ", 1)
        actor = F.coalesce(actor, F.nullif(ssh, F.lit("")))
    actor = F.when(
        F.lower(process).startswith("sudo"), F.nullif(F.regexp_extract(message, r"^\s*(\S+)", 1), F.lit(""))
    ).otherwise(actor)
    origin = F.regexp_extract(message, r" from\s+(\S+)", 1)
    return actor, F.when(looks_like_ip(origin), origin)


def _first_match(text: Column, word_lists) -> Column:
    """Position (from 1) of the first list with a word in the text, else null."""
    out = None
    for i, words in enumerate(word_lists, 1):
        hit = contains_any(text, words)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def linux_lookup(text: Column) -> Column:
    """First matching Linux pattern as a struct, else null."""
    rows = F.array(*[
        F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(about).alias("description"),
            F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"),
        )
        for _, kind, severity, about, technique, tactic in fixed.LINUX_PATTERNS
    ])
    return F.get(rows, _first_match(text, [p[0] for p in fixed.LINUX_PATTERNS]) - 1)


def normalise_linux(df: DataFrame, strict: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed Linux lines (hostname, process, message, timestamp) -> events."""
    message, process = F.col("message"), F.col("process")
    searched = F.lower(message if strict else F.concat(process, F.lit(": "), message))
    actor, target = linux_actors(message, process, strict)
    hit = F.col("_hit")
    out = df.withColumn("_hit", linux_lookup(searched)).select(
        content_id(F.col("hostname"), F.col("timestamp"), process, message).alias("event_id"),
        "timestamp",
        F.lit("linux").alias("platform"),
        or_unknown(F.col("hostname")).alias("source"),
        clean_text(F.coalesce(actor, process)).alias("actor"),
        clean_text(F.coalesce(target, F.col("hostname"))).alias("target"),
        F.coalesce(hit["type"], F.lit("system")).alias("event_type"),
        F.coalesce(hit["severity"], F.lit(1)).alias("severity"),
        F.lit(0).alias("raw_event_id"),
        F.coalesce(hit["description"], F.concat(process, F.lit(": "), truncate_text(message, 120))).alias("description"),
        F.coalesce(hit["technique"], F.lit("")).alias("mitre_technique"),
        F.coalesce(hit["tactic"], F.lit("")).alias("mitre_tactic"),
        message.alias("raw_payload"), *keep,
    )
    return _events(out, keep)


# ---- Network syslog ----

PRI = r"^<(\d{1,4})>"


def parse_syslog(df: DataFrame, year: int, as_of, col: str = "value") -> DataFrame:
    """Syslog messages -> facility, pri_severity, timestamp, hostname, app, proc_id, message, format.

    Each step is its own column, so that every pattern runs once per message.
    """
    df = df.withColumn("_raw", strip(F.col(col))).filter("_raw != ''")
    df = df.withColumn("_pri", F.regexp_extract("_raw", PRI, 1).try_cast("int"))
    df = df.withColumn("_rest", F.when(F.col("_pri").isNull(), F.col("_raw")).otherwise(F.regexp_replace("_raw", PRI, "")))
    rest = F.col("_rest")
    # RFC 5424: seven fields after the version digit; RFC 3164: a 15-character stamp, host, tag, message.
    fields = F.when(rest.startswith("1 "), F.split(F.substring(rest, 3, 1 << 30), " ", 7))
    df = df.withColumn("_fields", F.when(F.size(fields) >= 6, fields)).withColumns({
        "_new": F.when(F.col("_fields")[0].rlike(ISO_STAMP), iso_ts(F.col("_fields")[0])),
        "_old": F.when(rest.rlike(SYSLOG_STAMP), syslog_ts(rest, year)),
    })
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    df = df.withColumn("_body", F.when(is_old & ~is_new, F.split(F.trim(F.substring(rest, 16, 1 << 30)), " ", 2)))
    body = F.col("_body")
    df = df.withColumn("_said", F.trim(F.get(body, F.lit(1))))
    df = df.withColumn("_tag", F.when(F.col("_said").contains(":"), F.substring_index("_said", ":", 1)))
    said, tag = F.col("_said"), F.col("_tag")

    def field(i: int) -> Column:
        return F.nullif(F.get("_fields", F.lit(i)), F.lit("-"))

    none = F.lit("")
    return df.withColumns({
        "facility": F.coalesce(F.call_function("div", F.col("_pri"), F.lit(8)).cast("int"), F.lit(0)),
        "pri_severity": F.coalesce(F.col("_pri") % 8, F.lit(0)),
        "timestamp": F.coalesce("_new", "_old", instant(as_of)),
        "hostname": F.when(is_new, F.coalesce(field(1), none)).when(is_old, F.get(body, F.lit(0))).otherwise("unknown"),
        "app": F.when(is_new, F.coalesce(field(2), none)).when(tag.isNotNull(), F.substring_index(tag, "[", 1))
        .when(said.isNotNull(), "unknown").otherwise(none),
        "proc_id": F.when(is_new, F.coalesce(field(3), none)).when(tag.isNotNull(), F.regexp_extract(tag, r"\[([^\]]*)", 1))
        .otherwise(none),
        "message": F.when(is_new, F.trim(F.coalesce(F.get("_fields", F.lit(6)), none)))
        .when(tag.isNotNull(), F.trim(F.substring(said, F.length(tag) + 2, F.lit(1 << 30))))
        .when(said.isNotNull(), said).when(is_old, F.get(body, F.lit(0))).otherwise(rest),
        "format": F.when(is_new, "rfc5424").when(is_old, "rfc3164").otherwise("raw"),
    }).drop("_raw", "_pri", "_rest", "_fields", "_new", "_old", "_body", "_said", "_tag")


def device_type(host: Column, app: Column, message: Column) -> Column:
    """Kind of device behind a syslog message, first match wins."""
    h, a, m = F.lower(host), F.lower(app), F.lower(message)
    return (
        F.when(h.contains("pfsense") | a.contains("filterlog") | contains_any(m, ["filterlog", "pf:"]), "pfsense")
        .when(contains_any(m, ["iptables", "dst="]) | (m.contains("src=") & m.contains("dpt=")), "iptables")
        .when(contains_any(m, ["%cisco", "%sec-", "%aaa-"]) | a.contains("cisco"), "cisco")
        .when(a.contains("junos") | m.contains("junos"), "juniper")
        .when(h.contains("ubnt") | a.contains("ubnt") | m.contains("ubnt"), "ubiquiti")
        .when(contains_any(m, ["eventid=", "security id:"]), "windows-forwarded")
        .otherwise("generic")
    )


def cisco_fields(c: Column) -> Column:
    """(description, type, severity) of a Cisco message."""
    mnemonic = F.regexp_replace(F.trim(F.substring_index(c, ":", 1)), "^%", "")
    text = F.trim(F.substring(c, F.instr(c, ":") + 1, F.lit(1 << 30)))
    kinds = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
                      for _, kind, severity in fixed.CISCO_MNEMONICS])
    parsed = c.contains("%") & c.contains(":")
    hit = F.get(kinds, _first_match(F.upper(mnemonic), [words for words, _, _ in fixed.CISCO_MNEMONICS]) - 1)
    hit = F.coalesce(F.when(parsed, hit), F.struct(F.lit("network").alias("type"), F.lit(5).alias("severity")))
    return F.struct(
        F.when(parsed, F.concat(F.lit("["), mnemonic, F.lit("] "), text)).otherwise(c).alias("description"),
        hit["type"].alias("type"), hit["severity"].alias("severity"),
    )


def normalise_network(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed syslog (parse_syslog, ``device``, optional ``sender`` address) -> events, in one pass.

    Windows events forwarded over syslog become Windows events, whatever transport they came by.
    """
    if "sender" not in df.columns:
        df = df.withColumn("sender", F.lit("unknown"))
    if "device" not in df.columns:
        df = df.withColumn("device", device_type(F.col("hostname"), F.col("app"), F.col("message")))
    named = F.when(F.col("hostname").isin("", "unknown"), F.col("sender")).otherwise(F.col("hostname"))
    message, device, source = F.col("message"), F.col("device"), F.col("_source")
    pfsense, iptables, forwarded = (device == d for d in ("pfsense", "iptables", "windows-forwarded"))
    df = df.withColumns({
        "_source": or_unknown(named),
        "_cisco": F.when(device == "cisco", cisco_fields(message)),
        "_number": F.when(forwarded, forwarded_id(message)).otherwise(0),
    })
    number, known = F.col("_number"), F.col("_known")
    out = df.withColumn("_known", F.when(forwarded, windows_lookup(number))).select(
        content_id(source, F.col("timestamp"), F.col("app"), message).alias("event_id"),
        "timestamp",
        F.when(forwarded, "windows").otherwise("network").alias("platform"),
        source.alias("source"),
        F.when(forwarded, "unknown").otherwise(source).alias("actor"),
        F.when(forwarded, clean_text(source)).otherwise(dst_of(message)).alias("target"),
        F.when(forwarded, windows_type(number)).otherwise(F.coalesce(F.col("_cisco.type"), F.lit("network"))).alias("event_type"),
        F.when(forwarded, F.coalesce(known["severity"], F.lit(2)))
        .otherwise(F.coalesce(F.col("_cisco.severity"), syslog_severity(F.col("pri_severity")))).alias("severity"),
        number.alias("raw_event_id"),
        F.when(forwarded, F.coalesce(known["description"], F.concat(F.lit("Windows Event ID "), number)))
        .when(pfsense, pfsense_text(message)).when(iptables, iptables_text(message))
        .otherwise(truncate_text(F.coalesce(F.col("_cisco.description"), message), 160)).alias("description"),
        F.when(pfsense, "T1562").when(iptables, "T1046").otherwise(F.coalesce(known["technique"], F.lit("")))
        .alias("mitre_technique"),
        F.when(pfsense, "defense-evasion").when(iptables, "discovery").otherwise(F.coalesce(known["tactic"], F.lit("")))
        .alias("mitre_tactic"),
        message.alias("raw_payload"), *keep,
    )
    return _events(out, keep)
