"""Column functions on text: cleaning, truncation, extraction, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions import fixed


def blank(c: Column) -> Column:
    """True for null or empty text."""
    return c.isNull() | (c == "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(" \t\r\n\f\v"))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def contains_any(c: Column, words) -> Column:
    """True when the text contains one of the literal words; null counts as no match."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def truncate_text(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def clean_text(c: Column) -> Column:
    """Trim, map empty markers to 'unknown', drop control characters, truncate to 128."""
    t = strip(F.coalesce(c, F.lit("")))
    body = truncate_text(F.regexp_replace(t, r"[\x00-\x1f\x7f]", ""), 128)
    return F.when(t.isin("", "-", "N/A"), F.lit("unknown")).otherwise(body)


def clean_value(c: Column) -> Column:
    """Value markers that mean 'nothing' become empty text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin("", "-", "N/A", "NULL"), F.lit("")).otherwise(t)


def looks_like_ip(c: Column) -> Column:
    return F.coalesce((F.size(F.split(c, r"\.", -1)) == 4) | c.contains(":"), F.lit(False))


def dst_of(c: Column) -> Column:
    return or_unknown(F.regexp_extract(F.coalesce(c, F.lit("")), r"DST=\s*(\S+)", 1))


def payload_kv(c: Column, key: str) -> Column:
    """First ``key=value`` (or ``key: value``) in free text, null when absent."""
    pattern = "(?i)" + re.escape(key) + r"[=:\s]+([^\s,|]+)"
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))


def forwarded_id(c: Column) -> Column:
    """Windows event id inside a forwarded syslog message, else 0."""
    text = F.coalesce(c, F.lit(""))
    found = [
        F.regexp_extract(text, f"(?i){prefix}" + r"\s*[,:;]*(\d+)[,:;]*(?=\s|$)", 1)
        for prefix in ("eventid=", "event id:", "event id =")
    ]
    return F.coalesce(*[F.nullif(f, F.lit("")).try_cast("int") for f in found], F.lit(0))


def syslog_severity(c: Column) -> Column:
    levels = F.array(*[F.lit(v) for v in fixed.SYSLOG_SEVERITY])
    return F.when(c.between(0, 7), F.get(levels, c)).otherwise(F.lit(fixed.SYSLOG_SEVERITY_DEFAULT))


def pfsense_text(c: Column) -> Column:
    return (
        F.when(c.contains("block"), F.concat(F.lit("pfSense firewall block: "), truncate_text(c, 120)))
        .when(c.contains("pass"), F.concat(F.lit("pfSense firewall allow: "), truncate_text(c, 120)))
        .otherwise(F.concat(F.lit("pfSense: "), truncate_text(c, 140)))
    )


def iptables_text(c: Column) -> Column:
    return (
        F.when(c.contains("DROP"), F.concat(F.lit("iptables DROP: "), truncate_text(c, 120)))
        .when(c.contains("ACCEPT"), F.concat(F.lit("iptables ACCEPT: "), truncate_text(c, 120)))
        .otherwise(F.concat(F.lit("iptables: "), truncate_text(c, 140)))
    )


def content_id(*cols: Column) -> Column:
    """Deterministic id of a record, so that reading a source again does not create new events."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def entity_type(c: Column) -> Column:
    """user, ip, service or host, decided from the identifier alone."""
    head = F.split(c, "@").getItem(0)
    parts = F.split(c, "@", -1)
    service = "(?i)" + "|".join(f"(?:{p})" for p in fixed.SERVICE_ACTORS)
    dotted = (
        c.contains(".") & ~c.startswith("\\") & F.forall(F.split(c, r"\.", -1), lambda p: p != "")
    )
    return (
        F.when(blank(c) | (c == "unknown"), "user")
        .when(c.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(c.contains(":") & head.rlike("^[0-9a-fA-F:]+$"), "ip")
        .when((F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^\d{1,3}\.\d{1,3}"), "user")
        .when(c.rlike(service), "service")
        .when(dotted, "host")
        .when(c.endswith("$"), "host")
        .otherwise("user")
    )


def band(c: Column, bands, default: str) -> Column:
    """Name of the first (lower bound, name) pair the value reaches."""
    out = None
    for low, name in bands:
        out = F.when(c >= low, name) if out is None else out.when(c >= low, name)
    return out.otherwise(default)


def risk_label(c: Column) -> Column:
    return band(c, fixed.RISK_BANDS, "CLEAN")


def severity_name(c: Column) -> Column:
    return band(c, fixed.SEVERITY_BANDS, "INFO")
