"""The commands and their exit codes, log statistics, retention, sending, segments, SQL names."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli
from ledgerloom.functions import blake3, registry
from ledgerloom.operators import append, events, sync, verify
from ledgerloom.sources import scan
from tests.test_ledger import SEED, chain, write


def test_verify_and_its_exit_codes(spark, tmp_path, capsys):
    path = write(tmp_path, chain(4))
    assert cli.main(["-f", "json", "verify", "--wal", path], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["valid"] and found["events_verified"] == 4 and found["errors"] == [] and len(found["chain_root"]) == 64
    assert cli.main(["verify", "--wal", path, "--expected-root", found["chain_root"]], spark) == 0
    assert "Events verified: 4" in capsys.readouterr().out
    broken = chain(6)
    del broken[2]
    write(tmp_path, broken)
    out = tmp_path / "report.json"
    assert cli.main(["-f", "quiet", "verify", "--wal", path, "-o", str(out)], spark) == 1
    assert capsys.readouterr().out == "" and [e["error_type"] for e in json.loads(out.read_text())["errors"]] == ["chain_break", "sequence_gap"]
    assert cli.main(["-f", "json", "verify", "--wal", path, "--fail-fast"], spark) == 1
    assert len(json.loads(capsys.readouterr().out)["errors"]) == 1
    assert cli.main(["verify", "--wal", str(tmp_path / "missing")], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["verify"], spark)


def test_inspect_export_report(spark, tmp_path, capsys):
    (tmp_path / "log").mkdir()
    path = write(tmp_path / "log", chain(12))
    assert cli.main(["inspect", "--wal", path, "-n", "3"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[1].split("│")[0].strip() == "SEQ" and [x.split("│")[0].strip() for x in lines[3:6]] == ["10", "11", "12"] and "- CLAIM" in lines[3] and lines[-1].startswith("Legend")
    assert cli.main(["inspect", "--wal", path, "--sequence", "5"], spark) == 0
    assert json.loads(capsys.readouterr().out)["sequence"] == 5
    assert cli.main(["inspect", "--wal", path, "--sequence", "50"], spark) == 1
    assert cli.main(["inspect", "--wal", path, "--stats"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip())["total_events"] == 12
    assert cli.main(["-f", "quiet", "export", "--wal", path, "--export-format", "csv"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 13
    assert cli.main(["export", "--wal", path, "--from", "1999-01-01", "--to", "1999-01-02"], spark) == 1
    assert cli.main(["report", "--wal", path, "-o", str(tmp_path / "r.json"), "--template", "dora"], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["template"] == "dora"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "segment_20250101_000000.jsonl").write_text("\n")
    assert cli.main(["inspect", "--wal", str(tmp_path / "empty")], spark) == 1


def test_stats_and_keys(spark, tmp_path, capsys):
    rotation = {"type": "key_rotation", "new_key_id": "k2", "new_public_key": "00" * 32, "reason": "annual"}
    path = write(tmp_path, chain(5, payloads={3: rotation}))
    (tmp_path / "receipts.jsonl").write_text('{"event_id": "evt_1"}\n')
    (tmp_path / "dead_letters.jsonl").write_text('{"event_id": "evt_2"}\n')
    assert cli.main(["stats", "--wal", path], spark) == 0
    s = json.loads(capsys.readouterr().out)
    assert (s["seq"], s["segment_count"], s["receipts_count"], s["dead_letter_count"], s["unsynced_count"]) == (5, 1, 1, 1, 3)
    assert cli.main(["keys", "--wal", path], spark) == 0
    assert json.loads(capsys.readouterr().out)["new_key_id"] == "k2"


def test_retention_deletes_old_segments(spark, tmp_path):
    for day in (1, 2, 8, 9):
        (tmp_path / f"segment_202501{day:02d}_000000.jsonl").write_text("x\n")
    (tmp_path / "segment_odd.jsonl").write_text("x\n")
    assert sync.apply_retention(spark, str(tmp_path), F.to_timestamp(F.lit("2025-01-10 00:00:00"))) == (2, 3)
    assert sorted(p.name for p in tmp_path.glob("segment_2*")) == ["segment_20250108_000000.jsonl", "segment_20250109_000000.jsonl"]


def test_segments_roll_and_keep_their_order(spark, tmp_path):
    rows = spark.range(1, 301).select((F.col("id") % 3).cast("string").alias("stream_id"), F.col("id").alias("sequence"), F.to_json(F.struct("id")).alias("value"))
    append.write_segments(rows, str(tmp_path / "log"), bytes_per_file=300)
    lines = scan.read_lines(spark, str(tmp_path / "log")).orderBy("segment", "line_no").collect()
    assert len(lines) == 300 and len({r["segment"] for r in lines}) > 6
    per = {}
    for r in lines:
        k = json.loads(r["line"])["id"]
        per.setdefault(k % 3, []).append(k)
    assert all(v == sorted(v) for v in per.values())
    empty = rows.limit(0)
    append.write_segments(empty, str(tmp_path / "none"))


def test_payloads_without_a_form_are_not_signed(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1.5}',), ("no json",), (None,)], "p string")
    got = rows.select(events.sign_payloads(F.col("p"), SEED).alias("s")).collect()
    assert [r["s"]["signature"] is not None for r in got] == [True, False, False, False]
    assert got[0]["s"]["payload_hash"] == blake3.hexdigest(b'{"a":1}') and got[1]["s"]["error"]


def test_few_lanes_equal_many():
    messages = [bytes([k % 251]) * k for k in (0, 1, 63, 64, 65, 144, 1023, 1024, 1025, 3000)]
    assert [blake3.digest_many([m])[0] for m in messages] == [blake3.digest_many([m] * 12)[0] for m in messages]


def test_sql_names_and_metrics(spark, tmp_path):
    registry.register(spark)
    assert spark.sql("SELECT blake3_hex('') AS h").first()["h"] == blake3.hexdigest(b"")
    path = write(tmp_path, chain(3))
    registry.register_ledger(scan.read_ledger(spark, path), "log1")
    assert spark.sql("SELECT count(*) AS n FROM log1_findings").first()["n"] == 0
    rows, seen = events.observed(spark.range(10).withColumn("timestamp_ns", F.col("id") * 5), "flow1", failed=F.col("id") > 7)
    assert rows.count() == 10 and seen.get == {"received": 10, "failed": 2, "last_ns": 45}


def test_verify_with_root_lists_its_keys(spark, tmp_path):
    from ledgerloom.functions import ed25519

    path = write(tmp_path, chain(4))
    out = verify.verify_wal_with_root(scan.iter_records(spark, path), "test-key", ed25519.public_key(SEED)).first()
    assert out["valid"] and out["count"] == 4 and out["key_rotations"] == 0 and out["trusted_keys"] == ["test-key"]


def test_no_plan_puts_all_rows_into_one_task(spark, tmp_path):
    path = write(tmp_path, chain(3))
    ledger = scan.read_ledger(spark, path)
    for df in (verify.cli_findings(ledger), verify.chain_findings(verify.record_errors(ledger, spark.createDataFrame([("test-key", "00")], "key_id string, trusted_key string")), None)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("SinglePartition")[1:]:
            assert "__part" in part[:3000]  # the one row per partition that with_previous stitches
