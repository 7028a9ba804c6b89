"""Column expressions of the ledger: timestamps, hex checks, identities, severities, redaction. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: RFC 3339 with an optional offset (none means UTC) and up to nine fractional digits that count.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$"


def iso_to_ns(text: Column, digits: int = 9) -> Column:
    """Nanoseconds since 1970 of an ISO timestamp (null if malformed or out of range); digits: fractional digits kept (9, 6 or 3)."""
    seconds = F.regexp_replace(F.regexp_replace(F.upper(text), r"\.\d+", ""), " ", "T")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, digits), 9, "0")
    micros = F.unix_micros(F.try_to_timestamp(seconds))
    return F.when(text.rlike(RFC3339), F.try_add(F.try_multiply(micros, F.lit(1000)), fraction.cast("long")))


def any_to_ns(text: Column) -> Column:
    """As iso_to_ns; a plain integer is nanoseconds already."""
    return F.when(text.rlike(r"^-?\d{1,19}$"), text.try_cast("long")).otherwise(iso_to_ns(text))


def ns_to_rfc3339(ns: Column) -> Column:
    """RFC 3339 in UTC with as many of 0, 3, 6 or 9 fractional digits as needed."""
    below = F.pmod(ns, F.lit(1_000_000_000))
    seconds = ((ns - below) / 1_000_000_000).cast("long")
    nine = F.lpad(below.cast("string"), 9, "0")
    fraction = F.when(below == 0, "").when(below % 1_000_000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 3))).when(below % 1000 == 0, F.concat(F.lit("."), F.substring(nine, 1, 6))).otherwise(F.concat(F.lit("."), nine))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def hex_problem(name: str, value: Column, length: int, position: bool) -> Column:
    """A message about a hex field: its length first, then its characters; null if right."""
    at = F.regexp_instr(value, F.lit("[^0-9a-fA-F]")) - 1
    wrong = F.concat(F.lit(f"{name} contains invalid char '"), F.substr(value, at + 1, F.lit(1)), F.lit("' at position "), at.cast("string")) if position else F.lit(f"{name} contains invalid hex characters")
    return F.when(F.length(value) != length, F.concat(F.lit(f"{name} invalid length: expected {length} chars, got "), F.length(value).cast("string"))).when(at >= 0, wrong)


def hash_problems(prev_hash: Column, payload_hash: Column, signature: Column, public_key: Column) -> Column:
    """Array of up to four messages about a row's hex fields."""
    return F.array_compact(F.array(hex_problem("prev_hash", prev_hash, 64, True), hex_problem("payload_hash", payload_hash, 64, True), hex_problem("signature", signature, 128, False), hex_problem("public_key", public_key, 64, False)))


def stream_id(key_id: Column, namespace: Column) -> Column:
    return F.concat(F.lit("stream_"), F.left(F.sha2(F.concat(key_id, F.lit(":"), F.coalesce(F.when(namespace != "", namespace), F.lit("default"))), 256), F.lit(16)))


def event_id() -> Column:
    """A fresh id; nondeterministic."""
    return F.concat(F.lit("evt_"), F.expr("uuid()"))


def shortened(text: Column, n: int = 8) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def receipt_message(event: Column, payload_hash: Column, server_time: Column, server_seq: Column) -> Column:
    """What a receipt's signature covers."""
    return F.concat(event, F.lit("|"), payload_hash, F.lit("|"), server_time, F.lit("|"), server_seq.cast("string"))


# Severities by source.
SYSLOG_SEVERITY = {"debug": "debug", "info": "info", "notice": "info", "warning": "warning", "err": "high", "error": "high", "crit": "critical", "alert": "critical", "emerg": "critical"}
WINDOWS_SEVERITY = {"Information": "info", "Warning": "warning", "Error": "high", "Critical": "critical"}
LOG_LEVEL_SEVERITY = {"DEBUG": "debug", "INFO": "info", "WARNING": "warning", "ERROR": "high", "CRITICAL": "critical"}
SEVERITIES = ("debug", "info", "warning", "high", "critical")


def mapped(value: Column, table: dict[str, str], default: str = "info") -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(value == k, v)
    return chain.otherwise(default)


def syslog_severity(priority: Column) -> Column:
    return mapped(F.lower(priority), SYSLOG_SEVERITY)


def windows_severity(level: Column) -> Column:
    return mapped(level, WINDOWS_SEVERITY)


def log_level_severity(level: Column) -> Column:
    return mapped(level, LOG_LEVEL_SEVERITY)


def status_severity(code: Column) -> Column:
    return F.when(code >= 500, "high").when(code >= 400, "warning").otherwise("info")


def severity_rank(severity: Column) -> Column:
    """Place in the order of severities; null for unknown ones."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(at > 0, at - 1)


def redact_headers(headers: Column, allow: list[str], deny: list[str]) -> Column:
    """Headers on either list, names compared in lower case; denied ones, which win, with their values replaced."""
    lists = [*(x.lower() for x in allow), *(x.lower() for x in deny)]
    kept = F.map_filter(headers, lambda k, _: F.lower(k).isin(lists))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k).isin([x.lower() for x in deny]), F.lit("[REDACTED]")).otherwise(v))


def idempotency_key(request_id: Column, *parts: Column) -> Column:
    return F.concat(F.lit("req:"), F.coalesce(F.when(request_id != "", request_id), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(16))))


def normal_root(text: str) -> str:
    """An expected root as compared: trimmed, without 0x, in lower case."""
    return text.strip().removeprefix("0x").lower()
