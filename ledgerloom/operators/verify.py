"""Verification of ledgers in three profiles. Findings are rows; summaries, reports and fail-fast derive from them.

cli checks in file order and always advances; sdk checks each record first and leaves invalid ones out of the chain; node gives one status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ed25519
from ledgerloom.functions.expressions import GENESIS, hash_problems, normal_root, receipt_message
from ledgerloom.functions.hashing import entry_hash, payload_hash, signature_ok
from ledgerloom.operators.root import chain_root
from ledgerloom.plans.global_lag import previous_in
from ledgerloom.runtime import written

#: Error tags in the order of a row's checks.
RANKS = {"parse_error": 0, "invalid_genesis": 1, "chain_break": 3, "sequence_gap": 4, "timestamp_regression": 5, "invalid_signature": 6, "invalid_hash_format": 7, "payload_mismatch": 8, "root_mismatch": 9}
FINDING = "check_rank int, error_type string, details string"


def _finding(condition: Column, rank: int, kind: str, details: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rank).alias("check_rank"), F.lit(kind).alias("error_type"), details.cast("string").alias("details")))


def _text(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def with_entry_hash(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("entry_hash", entry_hash("sequence", "timestamp_ns", "prev_hash", "payload_hash"))


def cli_findings(ledger: DataFrame, stream: str | None = None, order: tuple[str, ...] = ("segment", "line_no"), check_payload: bool = True) -> DataFrame:
    """Findings (stream, order columns, sequence, check_rank, error_type, details) of a ledger.

    stream: the column that separates chains; None chains the whole directory, in one order that is spread over tasks.
    check_payload also re-hashes payloads where there are any.
    """
    keys = [stream] if stream else []
    place = [*keys, *order, *["sequence"] * ("sequence" not in order)]
    bad = ledger.filter("parse_error IS NOT NULL").select(*place, F.lit(0).alias("check_rank"), F.lit("parse_error").alias("error_type"), F.col("parse_error").alias("details"))
    rows = ledger.filter("parse_error IS NULL")
    if "entry_hash" not in rows.columns:
        rows = with_entry_hash(rows)
    rows = previous_in(rows, keys, list(order), ["entry_hash", "sequence", "timestamp_ns"])
    first = F.col("prev_sequence").isNull()
    seq = F.col("sequence").cast("string")
    signed = F.col("signature").isNotNull() & F.col("public_key").isNotNull()
    wrong_genesis = first & (F.col("prev_hash") != GENESIS)
    checks = [
        _finding(first & (F.col("sequence") != 1), 1, "invalid_genesis", F.concat(F.lit(f"Invalid genesis: prev_hash should be sequence=1, prev_hash={GENESIS[:16]}, found sequence="), seq)),
        _finding(wrong_genesis, 2, "invalid_genesis", F.concat(F.lit(f"Invalid genesis: prev_hash should be {GENESIS}, found "), F.col("prev_hash"))),
        _finding(~first & (F.col("prev_hash") != F.col("prev_entry_hash")), 3, "chain_break", _text("Chain break at sequence %s: expected %s, found %s", seq, F.col("prev_entry_hash"), F.col("prev_hash"))),
        _finding(~first & (F.col("sequence") != F.col("prev_sequence") + 1), 4, "sequence_gap", _text("Sequence gap: missing %s after %s", (F.col("prev_sequence") + 1).cast("string"), F.col("prev_sequence").cast("string"))),
        _finding(~first & (F.col("timestamp_ns") < F.col("prev_timestamp_ns")), 5, "timestamp_regression", _text("Timestamp regression at sequence %s: %s -> %s", seq, F.col("prev_timestamp_ns").cast("string"), F.col("timestamp_ns").cast("string"))),
        _finding(signed & ~F.coalesce(F.col("sig_ok"), F.lit(True)), 6, "invalid_signature", F.concat(F.lit("Invalid signature at sequence "), seq)),
    ]
    rows = rows.withColumn("sig_ok", F.when(signed, signature_ok(F.when(signed, F.col("public_key")), "entry_hash", "signature")))
    formats = F.transform(hash_problems(F.col("prev_hash"), F.col("payload_hash"), F.col("signature"), F.col("public_key")), lambda m: F.struct(F.lit(7).alias("check_rank"), F.lit("invalid_hash_format").alias("error_type"), F.concat(F.lit("Invalid hash format at sequence "), seq, F.lit(": "), m).alias("details")))
    found = F.concat(F.array_compact(F.array(*checks)), formats)
    if check_payload and "payload" in rows.columns:
        rows = rows.withColumn("__p", payload_hash(F.col("payload"), F.col("hash_alg")))
        mismatch = F.col("payload").isNotNull() & F.col("hash_alg").isNotNull() & ((F.col("__p.hash") != F.col("payload_hash")) | F.col("__p.error").isNotNull())
        found = F.concat(found, F.array_compact(F.array(_finding(mismatch, 8, "payload_mismatch", F.concat(F.lit("Payload hash mismatch at sequence "), seq)))))
    good = rows.select(*place, F.explode(found).alias("f")).select(*place, "f.*")
    return bad.unionByName(good)


def first_finding(findings: DataFrame, order: tuple[str, ...] = ("segment", "line_no")) -> DataFrame:
    """What fail-fast reports."""
    return first_findings(findings, 1, order)


def first_findings(findings: DataFrame, n: int = 5, order: tuple[str, ...] = ("segment", "line_no")) -> DataFrame:
    """The first n findings, in the order of rows and of a row's checks: what is shown of many."""
    return findings.orderBy(*order, "check_rank").limit(n)


def cli_summary(ledger: DataFrame, expected_root: str | None = None, check_payload: bool = False) -> DataFrame:
    """One row: valid, events_verified, signatures_verified, first and last, chain_root, n_errors, warnings.

    A directory without segments is valid with an empty root, whatever root is expected.
    """
    rows = with_entry_hash(ledger.filter("parse_error IS NULL"))
    findings = cli_findings(ledger, check_payload=check_payload)
    place = F.struct("segment", "line_no")
    facts = rows.agg(
        F.count("*").alias("events_verified"),
        F.min_by("sequence", place).alias("first_sequence"), F.max_by("sequence", place).alias("last_sequence"),
        F.min_by("timestamp_ns", place).alias("first_timestamp_ns"), F.max_by("timestamp_ns", place).alias("last_timestamp_ns"),
    )
    signed = rows.filter("signature IS NOT NULL AND public_key IS NOT NULL").agg(F.count_if(signature_ok("public_key", "entry_hash", "signature")).alias("signatures_verified"))
    errors = findings.agg(F.count("*").alias("n_errors"))
    empty = ledger.limit(1).count() == 0
    root = "" if empty else chain_root(rows, ["segment", "line_no"])
    wrong = expected_root is not None and not empty and root != normal_root(expected_root)
    warning = "No events found" if empty else "No expected root provided: verified internal consistency only. For full tamper-detection, compare chain_root against an external anchor." if expected_root is None else None
    joined = facts.crossJoin(signed).crossJoin(errors)  # one row each
    return joined.withColumn("n_errors", F.col("n_errors") + int(wrong)).select((F.col("n_errors") == 0).alias("valid"), "*", F.lit(root).alias("chain_root"), F.lit(warning).alias("warning"))


# Profile sdk


def record_errors(records: DataFrame, keys: DataFrame, server_key: tuple[str, str] | None = None) -> DataFrame:
    """records with entry_hash, error and status of the first failing check, and is_authoritative.

    keys: key_id, trusted_key (hex). server_key: key id and hex key that receipts must be signed with.
    """
    rows = with_entry_hash(records).join(keys, "key_id", "left")
    rows = rows.withColumn("__p", payload_hash(F.col("payload"), F.col("hash_alg"))).withColumn("__s", signature_ok("trusted_key", "entry_hash", "signature"))
    hash_error = F.when(F.col("__p.error").isNotNull(), F.concat(F.lit("Payload has no canonical form: "), F.col("__p.error"))).when(
        F.col("__p.hash") != F.col("payload_hash"), F.concat(F.lit("Hash mismatch: computed "), F.left("__p.hash", F.lit(16)), F.lit("... != stored "), F.left("payload_hash", F.lit(16)), F.lit("..."))
    )
    sig_error = F.when(F.col("trusted_key").isNull(), F.concat(F.lit("No key found for key_id '"), F.col("key_id"), F.lit("'"))).when(~F.coalesce("__s", F.lit(False)), "Client signature verification failed")
    receipt_error = F.lit(None).cast("string")
    authoritative = F.lit(False)
    if server_key:
        r = F.col("receipt")
        rows = rows.withColumn("__r", signature_ok(F.when(r.isNotNull(), F.lit(server_key[1])), receipt_message(r["event_id"], r["payload_hash"], r["server_time"], r["server_seq"]), r["receipt_sig"]))
        receipt_error = (
            F.when(r.isNull(), None)
            .when(~r["server_key_id"].eqNullSafe(F.lit(server_key[0])), F.concat(F.lit("Server key ID mismatch: receipt has "), F.coalesce(r["server_key_id"], F.lit("")), F.lit(f", verifying with {server_key[0]}")))
            .when(~r["event_id"].eqNullSafe(F.col("event_id")), "Receipt event_id doesn't match record - possible receipt substitution attack")
            .when(~r["payload_hash"].eqNullSafe(F.col("payload_hash")), "Receipt payload_hash doesn't match record")
            .when(~F.coalesce("__r", F.lit(False)), "Server receipt signature verification failed")
        )
        authoritative = r.isNotNull() & receipt_error.isNull()
    status = F.when(hash_error.isNotNull(), "invalid_hash").when(sig_error.isNotNull(), "invalid_sig").when(receipt_error.isNotNull(), "invalid_receipt").otherwise("valid")
    return rows.select(*records.columns, "entry_hash", F.coalesce(hash_error, sig_error, receipt_error).alias("error"), status.alias("status"), authoritative.alias("is_authoritative"))


def chain_findings(checked: DataFrame, stream: str | None = "stream_id", strict_timestamps: bool = True, strict_file_order: bool = False) -> DataFrame:
    """Findings of records from record_errors: their own errors, and the chain checks among those without."""
    keys = [stream] if stream else []
    order = ["segment", "line_no"] if strict_file_order else ["sequence", "segment", "line_no"]
    own = checked.filter("error IS NOT NULL").select(*keys, "segment", "line_no", "sequence", F.lit(0).alias("check_rank"), F.col("status").alias("error_type"), F.col("error").alias("details"))
    rows = previous_in(checked.filter("error IS NULL"), keys, order, ["entry_hash", "sequence", "ts_client_raw"])
    seq, before = F.col("sequence"), F.coalesce("prev_sequence", F.lit(0))
    checks = [
        _finding((seq == 1) & (F.col("prev_hash") != GENESIS), 1, "chain", F.lit("First record has invalid prev_hash (expected genesis)")),
        _finding((seq != 1) & (F.col("prev_hash") != F.coalesce("prev_entry_hash", F.lit(GENESIS))), 2, "chain", F.lit("Chain break: prev_hash doesn't match previous entry hash")),
        _finding((before > 0) & (seq <= before), 3, "chain", F.concat(_text("Sequence not monotonic: %s <= %s", seq.cast("string"), before.cast("string")), F.lit(" (strict file order: records out of order in file)" if strict_file_order else ""))),
        _finding((before > 0) & (seq != before + 1), 4, "chain", _text("Sequence gap: expected %s, got %s", (before + 1).cast("string"), seq.cast("string"))),
    ]
    if strict_timestamps:
        checks.append(_finding(F.col("ts_client_raw") < F.col("prev_ts_client_raw"), 5, "chain", F.lit("Timestamp not monotonic: current < previous")))
    good = rows.select(*keys, "segment", "line_no", "sequence", F.explode(F.array_compact(F.array(*checks))).alias("f")).select(*keys, "segment", "line_no", "sequence", "f.*")
    return own.unionByName(good)


def chain_summary(checked: DataFrame, stream: str | None = "stream_id", strict_timestamps: bool = True, strict_file_order: bool = False) -> DataFrame:
    """Per stream: valid, status, count, first_seq, last_seq, is_authoritative, n_errors, mode."""
    keys = [stream] if stream else []
    order = F.struct("segment", "line_no") if strict_file_order else F.struct("sequence", "segment", "line_no")
    facts = checked.groupBy(*keys).agg(F.count("*").alias("count"), F.min_by("sequence", order).alias("first_seq"), F.max_by("sequence", order).alias("last_seq"), F.bool_and("is_authoritative").alias("all_authoritative"))
    errors = chain_findings(checked, stream, strict_timestamps, strict_file_order).groupBy(*keys).agg(F.count("*").alias("n_errors"))
    joined = facts.join(errors, keys, "left") if keys else facts.crossJoin(errors)
    n = F.coalesce("n_errors", F.lit(0))
    return joined.select(*keys, (n == 0).alias("valid"), F.when(n == 0, "valid").otherwise("invalid_chain").alias("status"), "count", "first_seq", "last_seq", (F.coalesce("all_authoritative", F.lit(False)) & (n == 0)).alias("is_authoritative"), n.alias("n_errors"), F.lit("forensic" if strict_file_order else "resilient").alias("mode"))


def rotations(records: DataFrame) -> DataFrame:
    """Key rotations in a ledger: sequence, old_key_id, new_key_id, new_public_key, reason, timestamp."""
    at = lambda f: F.get_json_object("payload", f"$.{f}")
    return records.filter(at("type") == "key_rotation").select("stream_id", "segment", "line_no", "sequence", F.col("key_id").alias("old_key_id"), at("new_key_id").alias("new_key_id"), at("new_public_key").alias("new_public_key"), at("reason").alias("reason"), F.col("ts_client_raw").alias("timestamp"), "timestamp_ns", "prev_hash", "payload_hash", "signature")


def trusted_keys(records: DataFrame, root_key_id: str, root_key: bytes) -> dict[str, bytes]:
    """Keys by id that a chain of verified rotations, in file order, leads to from the root key.

    Only rotation rows reach the driver, one at a time. As in the log format's own rules, an old key stays trusted.
    """
    trusted = {root_key_id: root_key}
    for r in with_entry_hash(rotations(records)).orderBy("segment", "line_no").toLocalIterator():
        try:
            if r["old_key_id"] in trusted and ed25519.verify(trusted[r["old_key_id"]], r["entry_hash"].encode(), bytes.fromhex(r["signature"])):
                new = bytes.fromhex(r["new_public_key"])
                if len(new) == 32 and r["new_key_id"]:
                    trusted[r["new_key_id"]] = new
        except (TypeError, ValueError, AttributeError):
            continue
    return trusted


def verify_wal(records: DataFrame, keys: DataFrame, server_key: tuple[str, str] | None = None, stream: str | None = "stream_id", strict_timestamps: bool = True, strict_file_order: bool = False) -> DataFrame:
    """chain_summary of records (iter_records), each checked first against keys (key_id, trusted_key)."""
    checked = written(records.sparkSession, record_errors(records, keys, server_key), "checked")
    return chain_summary(checked, stream, strict_timestamps, strict_file_order)


def verify_wal_with_root(records: DataFrame, root_key_id: str, root_key: bytes, server_key: tuple[str, str] | None = None, **how) -> DataFrame:
    """verify_wal with the keys that verified rotations lead to from the root key, with key_rotations and trusted_keys (their ids)."""
    trusted = trusted_keys(records, root_key_id, root_key)
    keys = records.sparkSession.createDataFrame([(k, v.hex()) for k, v in trusted.items()], "key_id string, trusted_key string")
    out = verify_wal(records, keys, server_key, **how)
    return out.select("*", F.lit(len(trusted) - 1).cast("long").alias("key_rotations"), F.array(*map(F.lit, sorted(trusted))).alias("trusted_keys"))


def revoked(records: DataFrame, revocations: DataFrame) -> DataFrame:
    """Records signed after their key's valid_until (revocations: key_id, valid_until as ISO text, compared as text)."""
    return records.join(revocations, "key_id").filter(F.col("ts_client_raw") > F.col("valid_until"))


# Profile node


def node_verify(records: DataFrame, start: str | None = None, end: str | None = None, by: str | None = None) -> DataFrame:
    """One row, or one per by: status (EMPTY, TAMPERED, INCOMPLETE, VERIFIED), count, first_seq, last_seq, root_hash, missing_ranges."""
    if start is not None:
        records = records.filter(F.col("ts_client_raw") >= start)
    if end is not None:
        records = records.filter(F.col("ts_client_raw") <= end)
    order = ["sequence", "segment", "line_no"]
    rows = with_entry_hash(records).withColumn("__p", payload_hash(F.col("payload"), F.lit("blake3"), "node"))
    keys = [by] if by else []
    rows = previous_in(rows.withColumn("sig_ok", F.when(F.col("public_key").isNotNull(), signature_ok("public_key", "entry_hash", "signature"))), keys, order, ["entry_hash", "sequence"])
    seq, before = F.col("sequence"), F.coalesce("prev_sequence", F.lit(0))
    tampered = (
        ((seq == 1) & F.col("prev_sequence").isNull() & (F.col("prev_hash") != GENESIS))
        | ~F.col("__p.hash").eqNullSafe(F.col("payload_hash"))
        | ((seq > 1) & (F.col("prev_hash") != F.coalesce("prev_entry_hash", F.lit(GENESIS))))
        | (F.col("public_key").isNotNull() & ~F.coalesce("sig_ok", F.lit(False)))
    )
    gap = F.when(seq != before + 1, F.struct((before + 1).alias("from"), (seq - 1).alias("to")))
    lead_gap = F.when(F.col("prev_sequence").isNull() & (seq > 1), F.struct(F.lit(1).cast("long").alias("from"), (seq - 1).alias("to")))
    facts = rows.select(*keys, "sequence", "segment", "line_no", "entry_hash", tampered.alias("t"), F.array_compact(F.array(lead_gap, gap)).alias("gaps")).groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.bool_or("t").alias("t"),
        F.max_by("entry_hash", F.struct(*order)).alias("root"), F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("gaps") > 0, F.struct(*order, "gaps")))), lambda x: x["gaps"])).alias("gaps"),
    )
    status = F.when(F.col("count") == 0, "EMPTY").when(F.col("t"), "TAMPERED").when(F.size("gaps") > 0, "INCOMPLETE").otherwise("VERIFIED")
    shown = status.isin("INCOMPLETE", "VERIFIED")
    return facts.select(*keys, status.alias("status"), "count", "first_seq", "last_seq", F.when(shown, F.col("root")).alias("root_hash"), F.when(status == "INCOMPLETE", F.col("gaps")).alias("missing_ranges"))
