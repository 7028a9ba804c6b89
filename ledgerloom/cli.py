"""Commands over a log directory: verify, export, inspect, report, stats, keys.

    python -m ledgerloom.cli -f json verify --wal /logs/app1

Exit codes: 0 for success, 1 for a log that is not valid (or nothing to show), 2 for an error.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import export, inspect, report, sync, verify
from ledgerloom.sources.scan import read_ledger

#: Findings that a verification shows: all are counted.
SHOWN = 1000
PLACE = ("segment", "line_no")


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="ledgerloom")
    main.add_argument("-f", "--format", choices=("json", "text", "quiet"), default="text")
    main.add_argument("-v", "--verbose", action="store_true")
    commands = main.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("-w", "--wal", required=True)
        return c

    c = command("verify")
    c.add_argument("--expected-root")
    c.add_argument("-o", "--output")
    c.add_argument("--fail-fast", action="store_true")
    c = command("export")
    c.add_argument("-o", "--output")
    c.add_argument("--export-format", choices=("jsonl", "csv", "syslog"), default="jsonl")
    c.add_argument("--from", dest="start")
    c.add_argument("--to", dest="end")
    c.add_argument("--include-proofs", action="store_true")
    c = command("inspect")
    c.add_argument("-n", "--last", type=int, default=10)
    c.add_argument("--sequence", type=int)
    c.add_argument("--stats", action="store_true")
    c = command("report")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--template", choices=report.TEMPLATES, default="generic")
    command("stats")
    command("keys")
    return main


def verification(ledger: DataFrame, expected_root: str | None = None, fail_fast: bool = False) -> dict:
    """The result of a verification: cli_summary's row and the first findings as errors (one with fail_fast)."""
    found = verify.first_findings(verify.cli_findings(ledger, check_payload=False), 1 if fail_fast else SHOWN, PLACE)
    errors = [{"sequence": r["sequence"], "error_type": r["error_type"], "details": r["details"]} for r in found.collect()]
    return verify.cli_summary(ledger, expected_root).first().asDict() | {"errors": errors}


def table(events: DataFrame) -> list[str]:
    """Lines of a table of events: with receipts if any has an id, with sources else. Layouts are fixed values."""
    with_ids = not events.filter("event_id IS NOT NULL").isEmpty()
    shown = inspect.display(events).collect()  # as many as were asked for
    cut = lambda x, n: x if len(x) <= n else x[: n - 3] + "..."
    out = []
    if with_ids:
        out += ["", f"{'SEQ':>8} │ {'TIMESTAMP':^23} │ {'EVENT TYPE':^20} │ {'HASH':^10} │ {'SIGNED':^6} │ {'RECEIPT':^8}", "─" * 90]
    else:
        out += ["", f"{'SEQ':>8} │ {'TIMESTAMP':^23} │ {'EVENT TYPE':^20} │ {'SOURCE':^15} │ {'HASH':^10} │ {'SIGNED':^6}", "─" * 95]
    for s in shown:
        signed = "✓" if s["signed"] == "yes" else "-"
        head = f"{s['sequence']:>8} │ {s['timestamp'][:23]:^23} │ {cut(s['event_type'], 20):^20} │ "
        tail = f"{s['payload_hash']:^10} │ {signed:^6}"
        out.append(f"{head}{tail} │ {'✓ AUTH' if s['receipt'] == 'yes' else '- CLAIM':^8}" if with_ids else f"{head}{cut(s['source'], 15):^15} │ {tail}")
    out.append("")
    if with_ids:
        out.append("Legend: AUTH = Audit-grade proof (server receipt), CLAIM = Client integrity claim only")
    return out


def _verify(spark: SparkSession, a: argparse.Namespace) -> bool:
    found = verification(read_ledger(spark, a.wal), a.expected_root, a.fail_fast)
    text = json.dumps(found, indent=2)
    if a.format == "json":
        print(text)
    elif a.output:
        with open(a.output, "w") as f:
            f.write(text)
    elif a.format == "text":
        print(f"Valid: {found['valid']}\nEvents verified: {found['events_verified']}\nSignatures verified: {found['signatures_verified']}\nChain root: {found['chain_root']}")
        for e in found["errors"]:
            print(f"  [{e['error_type']}] {e['details']}")
        if found["warning"]:
            print(f"Warning: {found['warning']}")
    return found["valid"]


def _export(spark: SparkSession, a: argparse.Namespace) -> bool:
    rows = export.in_range(read_ledger(spark, a.wal).filter("parse_error IS NULL"), a.start, a.end)
    n = rows.count()
    if a.include_proofs and a.export_format != "jsonl":
        print(f"Warning: --include-proofs has no effect with {a.export_format}", file=sys.stderr)
    if a.output:
        export.write_export(rows, a.output, a.export_format, a.include_proofs)
    else:
        form = {"jsonl": export.jsonl_lines, "csv": export.csv_lines, "syslog": export.syslog_lines}[a.export_format]
        if a.export_format == "csv":
            print(",".join(export.COLUMNS))
        for r in form(export.export_rows(rows.orderBy(*PLACE), a.include_proofs and a.export_format == "jsonl")).toLocalIterator():
            print(r["value"])
    if a.format != "quiet":
        print(f"Exported {n} events", file=sys.stderr)
    return n > 0


def _inspect(spark: SparkSession, a: argparse.Namespace) -> bool:
    rows = read_ledger(spark, a.wal).filter("parse_error IS NULL")
    if a.stats:
        print(json.dumps(inspect.wal_stats(rows).first().asDict(recursive=True), indent=2))
        return True
    if a.sequence is not None:
        found = inspect.find_sequence(rows, a.sequence).select(F.to_json(F.struct("*")).alias("j")).first()
        if found is None:
            print(f"Event with sequence {a.sequence} not found", file=sys.stderr)
            return False
        print(json.dumps(json.loads(found["j"]), indent=2))
        return True
    last = inspect.last_events(rows, a.last)
    if last.isEmpty():
        print("No events found in WAL", file=sys.stderr)
        return False
    print("\n".join(table(last)))
    return True


def _report(spark: SparkSession, a: argparse.Namespace) -> bool:
    text = report.report_json(read_ledger(spark, a.wal).filter("parse_error IS NULL"), a.template)
    with open(a.output, "w") as f:
        f.write(text)
    status = json.loads(text)["overall_status"]
    if a.format != "quiet":
        print(f"Report generated: {a.output}\n  Template: {a.template}\n  Status: {status}", file=sys.stderr)
    return status == "PASS"


def _stats(spark: SparkSession, a: argparse.Namespace) -> bool:
    print(json.dumps(sync.log_stats(spark, a.wal).first().asDict(), indent=2))
    return True


def _keys(spark: SparkSession, a: argparse.Namespace) -> bool:
    for r in verify.rotations(read_ledger(spark, a.wal, "sdk").filter("parse_error IS NULL")).orderBy(*PLACE).toLocalIterator():
        print(json.dumps({k: r[k] for k in ("sequence", "old_key_id", "new_key_id", "reason", "timestamp")}))
    return True


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
        good = {"verify": _verify, "export": _export, "inspect": _inspect, "report": _report, "stats": _stats, "keys": _keys}[a.command](spark, a)
    except Exception as e:  # whatever fails: the exit code says so
        if a.format != "quiet":
            print(f"Error: {e}", file=sys.stderr)
        if a.verbose:
            raise
        return 2
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
