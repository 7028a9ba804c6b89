"""Compliance reports: an analysis row per ledger, a checklist by template, recommendations and an overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import GENESIS
from ledgerloom.operators.verify import with_entry_hash
from ledgerloom.plans.global_lag import previous_in

TEMPLATES = ("dora", "nis2", "generic")


def analyze(ledger: DataFrame, order: tuple[str, ...] = ("segment", "line_no"), by: str | None = None, entry_column: str = "entry_hash") -> DataFrame:
    """total_events, signatures_found, chain_intact, sequence_gaps and timestamp_regressions (lists of sequences) per by, or for all.

    signatures_found counts rows that have a signature; it does not verify them.
    """
    keys = [by] if by else []
    rows = ledger if entry_column in ledger.columns else with_entry_hash(ledger)
    rows = previous_in(rows, keys, list(order), [entry_column, "sequence", "timestamp_ns"])
    prev = {c: F.col(f"prev_{c}") for c in (entry_column, "sequence", "timestamp_ns")}
    rows = rows.select(*keys, *order, "sequence", "signature", (F.col("prev_hash") == F.coalesce(prev[entry_column], F.lit(GENESIS))).alias("linked"), (F.col("sequence") != prev["sequence"] + 1).alias("gap"), (prev["sequence"] + 1).alias("missing"), (F.col("timestamp_ns") < prev["timestamp_ns"]).alias("back"))
    listed = lambda flag, value: F.transform(F.sort_array(F.collect_list(F.when(flag, F.struct(*order, F.col(value).alias("v"))))), lambda x: x["v"])
    return rows.groupBy(*keys).agg(F.count("*").alias("total_events"), F.count("signature").alias("signatures_found"), F.coalesce(F.bool_and("linked"), F.lit(True)).alias("chain_intact"), listed(F.col("gap"), "missing").alias("sequence_gaps"), listed(F.col("back"), "sequence").alias("timestamp_regressions"))


def _check(requirement: str, status: Column, details: Column) -> Column:
    return F.struct(F.lit(requirement).alias("requirement"), status.alias("status"), details.alias("details"))


def _either(good: Column, bad: str, yes: Column, no: Column) -> tuple[Column, Column]:
    return F.when(good, "PASS").otherwise(bad), F.when(good, yes).otherwise(no)


def _list(column: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: x.cast("string")), ", "), F.lit("]"))


def checklist(template: str) -> Column:
    """The checks of a template over an analysis row: array of requirement, status, details. Texts are fixed values."""
    intact, gaps, back = F.col("chain_intact"), F.col("sequence_gaps"), F.col("timestamp_regressions")
    events, signed = F.col("total_events").cast("string"), F.col("signatures_found").cast("string")
    checks = [
        _check("Chain Integrity", *_either(intact, "FAIL", F.lit("All events are cryptographically linked"), F.lit("Chain breaks detected - possible tampering"))),
        _check("Sequence Continuity", *_either(F.size(gaps) == 0, "FAIL", F.lit("No sequence gaps detected"), F.concat(F.lit("Gaps found at sequences: "), _list(gaps)))),
        _check("Timestamp Monotonicity", *_either(F.size(back) == 0, "WARN", F.lit("All timestamps are monotonically increasing"), F.concat(F.lit("Regressions at sequences: "), _list(back)))),
    ]
    some = F.when(F.col("total_events") > 0, "PASS").otherwise("FAIL")
    kept = F.when(intact, "PASS").otherwise("FAIL")
    checks += {
        "dora": [_check("DORA Art. 12 - ICT Logging", some, F.concat(events, F.lit(" events recorded for audit trail"))), _check("DORA Art. 12 - Integrity Protection", kept, F.lit("Cryptographic hash chain protects log integrity"))],
        "nis2": [_check("NIS2 Art. 21 - Security Measures", kept, F.lit("Audit logs are cryptographically protected")), _check("NIS2 Art. 23 - Incident Reporting", F.lit("INFO"), F.concat(F.lit("Audit trail contains "), events, F.lit(" events for incident analysis")))],
        "generic": [_check("Digital Signatures", F.when(F.col("signatures_found") > 0, "PASS").otherwise("WARN"), F.concat(signed, F.lit("/"), events, F.lit(" events have digital signatures")))],
    }[template]
    return F.array(*checks)


def recommendations() -> Column:
    """Array of texts (fixed values) about an analysis row."""
    gaps, none = F.col("sequence_gaps"), F.col("total_events") == 0
    found = F.array_compact(F.array(
        F.when(~F.col("chain_intact"), "CRITICAL: Chain integrity compromised. Investigate potential tampering."),
        F.when(F.size(gaps) > 0, F.concat(F.lit("WARNING: "), F.size(gaps).cast("string"), F.lit(" sequence gaps detected. Review log collection infrastructure."))),
        F.when((F.col("signatures_found") == 0) & ~none, "NOTICE: No digital signatures found. Consider enabling WAL signing for enhanced non-repudiation."),
        F.when(none, "WARNING: No events found. Verify WAL path and log collection."),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No issues detected. Audit trail is compliant.")))


def overall_status() -> Column:
    """PASS iff intact, without gaps and without regressions; signatures don't matter."""
    return F.when(F.col("chain_intact") & (F.size("sequence_gaps") == 0) & (F.size("timestamp_regressions") == 0), "PASS").otherwise("FAIL")


def report(ledger: DataFrame, template: str = "generic", **how) -> DataFrame:
    """The analysis row with checklist, recommendations and overall_status."""
    return analyze(ledger, **how).select("*", checklist(template).alias("checklist"), recommendations().alias("recommendations"), overall_status().alias("overall_status"))


def report_json(ledger: DataFrame, template: str = "generic") -> str:
    """The report as pretty JSON."""
    import json

    row = report(ledger, template).select(F.to_json(F.struct("*")).alias("j")).first()
    return json.dumps(json.loads(row["j"]) | {"template": template}, indent=2)
