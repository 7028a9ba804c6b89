"""Scenarios: logs written to disk, tampered with, and verified in each profile."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import blake3, ed25519
from ledgerloom.functions.canonical import canonical_json
from ledgerloom.functions.hashing import entry_preimage
from ledgerloom.operators import append, attest, export, inspect, report, sync, verify
from ledgerloom.operators.root import chain_root
from ledgerloom.plans.global_lag import with_previous
from ledgerloom.sources import keys, scan

SEED, OTHER = bytes(range(32)), bytes(range(1, 33))
GENESIS = "0" * 64


def chain(n=3, seed=SEED, payloads=None, start=1, prev=GENESIS, key_id="test-key", sign=True, step=10**9):
    """n SDK records as dicts."""
    out = []
    for k in range(n):
        seq, ns = start + k, 1737720000 * 10**9 + (start + k) * step
        payload = (payloads or {}).get(seq, {"event": f"e{seq}"})
        h = blake3.hexdigest(canonical_json(payload))
        entry = blake3.hexdigest(entry_preimage(seq, ns, prev, h))
        out.append({"format_version": 1, "event_id": f"evt_{seq}", "stream_id": "s", "seq": seq, "prev_hash": prev, "ts_client": f"2025-01-24T12:{seq // 60:02d}:{seq % 60:02d}+00:00", "payload": payload, "payload_hash": h, "hash_alg": "blake3", "sig_client": ed25519.sign(seed, entry.encode()).hex() if sign else "", "key_id": key_id, "public_key": ed25519.public_key(seed).hex(), "receipt": None})
        prev = entry
    return out


def write(path, records, name="segment_20250124_120000.jsonl"):
    (path / name).write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records))
    return str(path)


def kinds(df):
    return sorted(((r["error_type"], r["sequence"]) for r in df.collect()), key=str)


def cli(spark, path, **how):
    return verify.cli_findings(scan.read_ledger(spark, path), **how)


def test_valid_chain(spark, tmp_path):
    path = write(tmp_path, chain(5))
    assert kinds(cli(spark, path)) == []
    s = verify.cli_summary(scan.read_ledger(spark, path)).first()
    assert s["valid"] and s["events_verified"] == s["signatures_verified"] == 5 and (s["first_sequence"], s["last_sequence"]) == (1, 5)
    entries = [blake3.hexdigest(entry_preimage(r["seq"], 1737720000 * 10**9 + r["seq"] * 10**9, r["prev_hash"], r["payload_hash"])) for r in chain(5)]
    assert s["chain_root"] == blake3.hexdigest("".join(entries).encode())
    assert verify.cli_summary(scan.read_ledger(spark, path), expected_root="0x" + s["chain_root"].upper()).first()["valid"]
    wrong = verify.cli_summary(scan.read_ledger(spark, path), expected_root="ab").first()
    assert not wrong["valid"] and wrong["n_errors"] == 1


def test_empty_directory_is_valid(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no segment")
    s = verify.cli_summary(scan.read_ledger(spark, str(tmp_path)), expected_root="ab").first()
    assert s["valid"] and s["events_verified"] == 0 and s["chain_root"] == ""


def test_cli_findings(spark, tmp_path):
    r = chain(8)
    r[2]["prev_hash"] = "f" * 64  # breaks its link, its signature and its successor's link
    r[4]["sig_client"] = r[4]["sig_client"][:10] + "0000000000" + r[4]["sig_client"][20:]
    r[6]["payload"] = {"event": "tampered"}
    del r[5]
    path = write(tmp_path, [*r[:3], "", "   \t ", '{"event": "incomplete_json_no_closing', *r[3:], '{"event_id": "evt_123", "seq": 1}'])
    want = [("chain_break", 3), ("invalid_signature", 3), ("chain_break", 4), ("invalid_signature", 5), ("chain_break", 7), ("sequence_gap", 7), ("payload_mismatch", 7), ("parse_error", None), ("parse_error", 1)]
    assert kinds(cli(spark, path)) == sorted(want, key=str)


def test_genesis_and_formats(spark, tmp_path):
    lines = [{"sequence": 5, "timestamp_ns": 10, "prev_hash": "deadbeef", "payload_hash": "p1"}, {"sequence": 6, "timestamp_ns": 9, "prev_hash": "x", "hash": "zz" * 32}]
    got = kinds(cli(spark, write(tmp_path, lines, "00000001.wal")))
    assert got == sorted([("invalid_genesis", 5), ("invalid_genesis", 5), ("invalid_hash_format", 5), ("invalid_hash_format", 5), ("chain_break", 6), ("timestamp_regression", 6), ("invalid_hash_format", 6), ("invalid_hash_format", 6)], key=str)
    first = verify.first_finding(cli(spark, str(tmp_path))).first()
    assert first["error_type"] == "invalid_genesis" and "sequence=5" in first["details"]


def test_duplicate_alias_is_a_parse_error_and_side_files_are_no_segments(spark, tmp_path):
    r = chain(2)
    write(tmp_path, [r[0], r[1] | {"sequence": 2}])
    write(tmp_path, [{"event_id": "evt_1", "receipt": {}, "attached_at": "x"}], "receipts.jsonl")
    assert kinds(cli(spark, str(tmp_path))) == [("parse_error", 2)]
    assert kinds(verify.cli_findings(scan.read_ledger(spark, str(tmp_path), "cli_strict"))) == sorted([("parse_error", None), ("parse_error", 2)], key=str)


def checked(spark, path, server=None, trusted=None):
    return verify.record_errors(scan.iter_records(spark, path), keys.key_table(spark, trusted or {"test-key": ed25519.public_key(SEED)}), server)


def test_sdk_resilient_and_forensic(spark, tmp_path):
    r = chain(4)
    path = write(tmp_path, [r[0], r[2], r[1], r[3]])
    c = checked(spark, path).cache()
    assert verify.chain_summary(c).first()["valid"]
    strict = verify.chain_summary(c, strict_file_order=True).first()
    assert not strict["valid"] and strict["mode"] == "forensic" and strict["status"] == "invalid_chain"


def test_sdk_invalid_record_leaves_the_chain(spark, tmp_path):
    r = chain(4)
    r[1]["payload"] = {"event": "changed"}
    found = verify.chain_findings(checked(spark, write(tmp_path, r)))
    got = sorted((x["sequence"], x["error_type"], x["details"].split(":")[0]) for x in found.collect())
    assert got == [(2, "invalid_hash", "Hash mismatch"), (3, "chain", "Chain break"), (3, "chain", "Sequence gap")]


def test_sdk_duplicates_floats_and_unknown_keys(spark, tmp_path):
    r = chain(3)
    dup = dict(r[1])
    path = write(tmp_path, [*r, dup, r[2] | {"seq": 9, "key_id": "nobody"}, json.dumps(r[2] | {"seq": 10}).replace('"e3"', "1.0")])
    got = {(x["sequence"], x["details"].split(":")[0].split("'")[0]) for x in verify.chain_findings(checked(spark, path)).collect()}
    assert {(2, "Sequence not monotonic"), (2, "Sequence gap"), (9, "No key found for key_id "), (10, "Payload has no canonical form")} <= got


def test_receipts(spark, tmp_path):
    r = chain(2)
    server = bytes(range(2, 34))
    path = write(tmp_path, r)

    def receipt(rec, **change):
        body = {"event_id": rec["event_id"], "payload_hash": rec["payload_hash"], "server_time": "t", "server_seq": 7, "server_key_id": "srv"} | change
        return body | {"receipt_sig": ed25519.sign(server, f"{body['event_id']}|{body['payload_hash']}|t|7".encode()).hex()}

    log = [{"event_id": "evt_1", "receipt": receipt(r[0], server_key_id="old")}, {"event_id": "evt_1", "receipt": receipt(r[0])}, {"event_id": "evt_2", "receipt": receipt(r[0])}, "not json"]
    write(tmp_path, log, "receipts.jsonl")
    c = checked(spark, path, ("srv", ed25519.public_key(server).hex())).orderBy("sequence").collect()
    assert c[0]["is_authoritative"] and c[0]["error"] is None
    assert c[1]["status"] == "invalid_receipt" and "substitution" in c[1]["error"]
    assert sync.substituted(scan.iter_records(spark, path).drop("receipt"), scan.read_receipts(spark, path)).count() == 1
    assert {x[0] for x in scan.read_synced_ids(spark, path).collect()} == {"evt_1", "evt_2"}
    assert scan.get_record(spark, path, "evt_2").first()["receipt"]["event_id"] == "evt_1"


def test_key_rotation_and_forgery(spark, tmp_path):
    good = {"type": "key_rotation", "new_key_id": "k2", "new_public_key": ed25519.public_key(OTHER).hex(), "reason": "r"}
    forged = {"type": "key_rotation", "new_key_id": "evil", "new_public_key": ed25519.public_key(bytes(32)).hex()}
    r = chain(3, payloads={2: good, 3: forged})
    r[2]["sig_client"] = "00" * 64
    path = write(tmp_path, r)
    records = scan.iter_records(spark, path)
    trusted = verify.trusted_keys(records, "test-key", ed25519.public_key(SEED))
    assert set(trusted) == {"test-key", "k2"} and trusted["k2"] == ed25519.public_key(OTHER)
    assert [x["new_key_id"] for x in verify.rotations(records).orderBy("sequence").collect()] == ["k2", "evil"]


def node_chain(n):
    r = chain(n)
    for x in r:
        x["public_key"] = base64.b64encode(ed25519.public_key(SEED)).decode()
    return r


def test_node_statuses(spark, tmp_path):
    r = node_chain(4)
    path = write(tmp_path, r, "segment_current.jsonl")
    read = lambda: scan.read_ledger(spark, path, "node").filter("parse_error IS NULL")
    ok = verify.node_verify(read()).first()
    assert ok["status"] == "VERIFIED" and ok["count"] == 4 and len(ok["root_hash"]) == 64
    assert verify.node_verify(read(), "2020", "2021").first()["status"] == "EMPTY"
    late = verify.node_verify(read(), start=r[1]["ts_client"]).first()
    assert late["status"] == "TAMPERED"
    write(tmp_path, [*r[:2], r[2] | {"payload": {"x": 1}}, r[3]], "segment_current.jsonl")
    assert verify.node_verify(read()).first()["status"] == "TAMPERED"
    a = attest.attest(scan.read_ledger(spark, write(tmp_path, r, "segment_current.jsonl"), "node"), "s", SEED, "k", "2020", "2030")
    assert a["status"] == "VERIFIED" and attest.attestation_ok(a) and not attest.attestation_ok(a | {"count": 3})
    assert a["attestation_id"] == attest.attestation_id("s", "2020", "2030", a["root_hash"])


def test_inspect_export_report(spark, tmp_path):
    path = write(tmp_path, chain(12))
    ledger = scan.read_ledger(spark, path)
    s = inspect.wal_stats(ledger).first()
    assert s["total_events"] == 12 and s["chain_intact"] and s["is_sdk_format"] and s["stream_ids"] == ["s"] and s["events_without_receipt"] == 12
    assert inspect.segment_stats(ledger).first()["segment_count"] == 1
    assert [x["sequence"] for x in inspect.last_events(ledger, 3).collect()] == [10, 11, 12] and inspect.last_events(ledger, 0).count() == 0
    assert inspect.find_sequence(ledger, 4).first()["event_id"] == "evt_4" and inspect.find_sequence(ledger, 99).count() == 0
    part = export.in_range(ledger, "2025-01-24T12:00:02Z", "2025-01-24T12:00:04Z")
    assert [x["sequence"] for x in part.orderBy("sequence").collect()] == [2, 3, 4]
    assert export.in_range(ledger, "2025-01-24", "2025-01-24").count() == 12
    with pytest.raises(ValueError):
        export.in_range(ledger, "2025-02-01", "2025-01-01")
    m = json.loads(export.manifest(part))
    assert (m["event_count"], m["first_sequence"], m["last_sequence"]) == (3, 2, 4)
    for form in ("jsonl", "csv", "syslog"):
        export.write_export(ledger, str(tmp_path / f"out-{form}"), form)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out-syslog")).collect())
    assert len(lines) == 12 and lines[0].startswith("<14>1 2025-01-24T12:00:01+00:00 ledgerloom unknown - - - seq=1 hash=")
    assert json.loads(spark.read.text(str(tmp_path / "out-jsonl")).first()["value"])["event_type"] == "unknown"
    assert spark.read.csv(str(tmp_path / "out-csv"), header=True).count() == 12
    assert export.csv_lines(spark.createDataFrame([(1, "t", 'a,"b"', "s", "h")], "sequence long, timestamp string, event_type string, source string, payload_hash string")).first()[0] == '1,t,"a,""b""",s,h'
    for template in report.TEMPLATES:
        r = json.loads(report.report_json(ledger, template))
        assert r["overall_status"] == "PASS" and r["recommendations"] == ["No issues detected. Audit trail is compliant."]
    r = report.report(ledger.filter("sequence <> 5"), "dora").first()
    assert r["overall_status"] == "FAIL" and r["checklist"][1]["details"] == "Gaps found at sequences: [5]" and not r["chain_intact"]
    nothing = report.report(ledger.limit(0)).first()
    assert nothing["recommendations"] == ["WARNING: No events found. Verify WAL path and log collection."]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 50, 333])
def test_chain_root_is_the_plain_hash(spark, n):
    hashes = [blake3.hexdigest(str(k).encode()) for k in range(n)]
    rows = spark.createDataFrame(list(enumerate(hashes)), "k long, h string")
    assert chain_root(rows, ["k"], "h") == blake3.hexdigest("".join(hashes).encode())


def test_chain_root_of_many_levels(spark):
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    text = "".join(r["h"] for r in rows.orderBy("k").collect())
    assert chain_root(rows, ["k"], "h") == blake3.hexdigest(text.encode())


def test_global_previous(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("v"))
    got = with_previous(rows, ["k"], ["v"]).orderBy("k").collect()
    assert [r["prev_v"] for r in got] == [None, *(r["v"] for r in got[:-1])]


def test_append_goes_on_and_verifies(spark):
    events = spark.createDataFrame([("s1", f"e{k}", "2025-01-24T12:00:00Z", k, json.dumps({"n": k, "é": "é"})) for k in range(6)] + [("s2", "x", "t", 5, "{}")], "stream_id string, event_id string, ts_client string, timestamp_ns long, payload string")
    first = append.append(events.filter("timestamp_ns < 3 or stream_id = 's2'"), SEED, "k").cache()
    more = append.append(events.filter("timestamp_ns >= 3 and stream_id = 's1'"), SEED, "k", append.chain_states(first))
    rows = [r for r in first.unionByName(more).orderBy("stream_id", "seq").collect() if r["stream_id"] == "s1"]
    assert [r["seq"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r["prev_hash"] for r in rows] == [GENESIS, *(r["entry_hash"] for r in rows[:-1])]
    assert all(ed25519.verify(ed25519.public_key(SEED), r["entry_hash"].encode(), bytes.fromhex(r["sig_client"])) for r in rows)
    line = json.loads(append.record_lines(first).first()["value"])
    assert line["payload"] in ({}, {"n": 0, "é": "é"}, {"n": 1, "é": "é"}, {"n": 2, "é": "é"}) and line["format_version"] == 1


def test_sync_and_legacy(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    left = sync.unsynced(ids("a", "b", None, "c"), ids("a"), ids("b", "b"))
    assert {r[0] for r in left.collect()} == {None, "c"}
    write(tmp_path, [{"seq": 1, "ts": "t", "event": {"a": 1}}, {"seq": 2, "ts": "t", "event": {}}, "{"], "wal_1.jsonl")
    write(tmp_path, [{"seq": 1, "synced": False, "sync_attempts": 1}, {"seq": 1, "synced": True, "sync_attempts": 2}, {"seq": 2, "synced": False, "sync_attempts": 3}], "sync_state.jsonl")
    entries, states = scan.read_legacy(spark, str(tmp_path))
    s = sync.buffer_stats(entries, states).first()
    assert (s["total"], s["synced"], s["pending"]) == (2, 1, 1)
    assert sync.to_retry(entries, states).count() == 0 and sync.to_retry(entries, states, 4).count() == 1
    assert sync.removable_files(entries, states, 0).count() == 0
    actions = sync.classify_responses(spark.createDataFrame([("a", 201), ("b", 503), ("c", 422), ("d", 404)], "event_id string, code int")).orderBy("event_id").collect()
    assert [a["action"] for a in actions] == ["receipt", "retry", "dead_letter", "stop"]
    plan = sync.retention_plan(spark.createDataFrame([("segment_20240101_000000.jsonl",), ("segment_20240109_000000_2.jsonl",), ("segment_20240110_000000.jsonl",), ("other",)], "segment string").filter("segment <> 'other'"), F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    assert [r["expired"] for r in plan.orderBy("segment").collect()] == [True, True, False]


def test_keys(tmp_path, monkeypatch):
    for form in ("pem", "hex", "raw"):
        keys.save_seed(SEED, str(tmp_path / form), form)
        assert keys.seed_from_file(str(tmp_path / form)) == SEED
    assert keys.seed_from_text(base64.b64encode(SEED).decode()) == SEED
    monkeypatch.setenv("LEDGER_KEY", SEED.hex())
    assert keys.seed_from_environment("LEDGER_KEY") == SEED
    with pytest.raises(ValueError):
        keys.seed_from_text("AAAA")
    assert "PUBLIC KEY" in keys.public_pem(ed25519.public_key(SEED))
