"""Filtered exports as JSON lines, CSV and syslog, and their manifest."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import ns_to_rfc3339
from ledgerloom.operators.root import chain_root
from ledgerloom.operators.verify import with_entry_hash

COLUMNS = ("sequence", "timestamp", "event_type", "source", "payload_hash")


def parse_bound(text: str, upper: bool = False) -> int:
    """Nanoseconds of an RFC 3339 time or a plain date (the whole day for an upper bound)."""
    if len(text) == 10:
        text += "T23:59:59.999999+00:00" if upper else "T00:00:00+00:00"
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("a time needs an offset")
    past = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return ((past.days * 86400 + past.seconds) * 10**6 + past.microseconds) * 1000 + (999 if upper and text.endswith(".999999+00:00") else 0)


def in_range(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows within [start, end]; with an end alone the lower bound is 1970."""
    if start is None and end is None:
        return ledger
    low = parse_bound(start) if start else 0
    high = parse_bound(end, True) if end else (1 << 63) - 1
    if low > high:
        raise ValueError("the range ends before it starts")
    return ledger.filter(F.col("timestamp_ns").between(low, high))


def in_text_range(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose timestamp text lies within [start, end], compared as text."""
    if start is not None:
        ledger = ledger.filter(F.col("ts_client_raw") >= start)
    return ledger if end is None else ledger.filter(F.col("ts_client_raw") <= end)


def export_rows(ledger: DataFrame, proofs: bool = False, event_type: Column | None = None, source: Column | None = None) -> DataFrame:
    """COLUMNS of each row (unknown for missing types and sources), with chain_proof where asked."""
    kind = F.col("event_type") if event_type is None else event_type
    origin = F.col("source") if source is None else source
    columns = [F.col("sequence"), ns_to_rfc3339(F.col("timestamp_ns")).alias("timestamp"), F.coalesce(kind, F.lit("unknown")).alias("event_type"), F.coalesce(origin, F.lit("unknown")).alias("source"), F.col("payload_hash")]
    if proofs:
        ledger = ledger if "entry_hash" in ledger.columns else with_entry_hash(ledger)
        columns.append(F.struct("prev_hash", "entry_hash", "signature").alias("chain_proof"))
    return ledger.select(*columns)


def jsonl_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def syslog_lines(rows: DataFrame, app: str = "ledgerloom") -> DataFrame:
    """Lines of RFC 5424 with priority 14 (user, info); app stands where the host name does."""
    return rows.select(F.format_string(f"<14>1 %s {app} %s - - - seq=%s hash=%s", "timestamp", "source", F.col("sequence").cast("string"), "payload_hash").alias("value"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """Lines of RFC 4180, without the header."""
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")) for c in COLUMNS]
    return rows.select(F.concat_ws(",", *quoted).alias("value"))


def write_export(ledger: DataFrame, path: str, form: str = "jsonl", proofs: bool = False) -> None:
    """Writes an export in file order, one folder of part files."""
    rows = export_rows(ledger.orderBy("segment", "line_no"), proofs and form == "jsonl")
    if form == "csv":
        rows.write.csv(path, header=True, escape='"')
    else:
        {"jsonl": jsonl_lines, "syslog": syslog_lines}[form](rows).write.text(path)


def manifest(ledger: DataFrame) -> str:
    """JSON about the exported rows; its root is over these rows alone."""
    rows = ledger if "entry_hash" in ledger.columns else with_entry_hash(ledger)
    place = F.struct("segment", "line_no")
    r = rows.agg(F.count("*").alias("event_count"), F.min_by("sequence", place).alias("first_sequence"), F.max_by("sequence", place).alias("last_sequence"), F.min_by(ns_to_rfc3339(F.col("timestamp_ns")), place).alias("first_timestamp"), F.max_by(ns_to_rfc3339(F.col("timestamp_ns")), place).alias("last_timestamp")).first()
    return json.dumps(r.asDict() | {"chain_root_hash": chain_root(rows, ["segment", "line_no"])}, indent=2)
