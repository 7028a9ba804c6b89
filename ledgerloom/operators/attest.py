"""Signed attestations of a period of a log."""

from __future__ import annotations

import base64
import json
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.functions import blake3, ed25519
from ledgerloom.functions.canonical import canonical_json
from ledgerloom.operators.verify import node_verify
from ledgerloom.runtime import ship

#: What the signature covers.
SIGNED_FIELDS = ("attestation_id", "stream_id", "period", "status", "count", "first_seq", "last_seq", "root_hash", "issued_at")


def attestation_id(stream_id: str, start: str, end: str, root: str | None) -> str:
    """Deterministic: 16 hex digits of BLAKE3."""
    return blake3.hexdigest(f"{stream_id}|{start}|{end}|{root or ''}".encode())[:16]


def _text(t: datetime) -> str:
    return t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def _signed(found: dict, stream_id: str, start: str, end: str, now: datetime, seed: bytes, key_id: str) -> dict:
    body = {"attestation_id": attestation_id(stream_id, start, end, found["root_hash"]), "stream_id": stream_id, "period": {"start": start, "end": end}, "issued_at": _text(now)} | {k: v for k, v in found.items() if v is not None}
    signed = {k: body[k] for k in SIGNED_FIELDS if k in body}
    return body | {"signer": {"key_id": key_id, "public_key": base64.b64encode(ed25519.public_key(seed)).decode()}, "signature": base64.b64encode(ed25519.sign(seed, canonical_json(signed, "node"))).decode()}


def attest(records: DataFrame, stream_id: str, seed: bytes, key_id: str, start: str | None = None, end: str | None = None, now: datetime | None = None) -> dict:
    """Verifies a period (the last day by default) and signs the outcome. Absent values have no key."""
    now = now or datetime.now(timezone.utc)
    start, end = start or _text(now - timedelta(days=1)), end or _text(now)
    found = node_verify(records, start, end).first().asDict(recursive=True)
    return _signed(found, stream_id, start, end, now, seed, key_id)


def attest_streams(records: DataFrame, seed: bytes, key_id: str, start: str, end: str, now: datetime | None = None) -> DataFrame:
    """An attestation of the period per stream: stream_id, attestation_id, status, count, root_hash, signature, body (as JSON)."""
    now = now or datetime.now(timezone.utc)
    found = node_verify(records, start, end, by="stream_id")

    def sign(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                body = _signed({k: v for k, v in r.items() if k != "stream_id"}, r["stream_id"], start, end, now, seed, key_id)
                rows.append({"stream_id": r["stream_id"], "attestation_id": body["attestation_id"], "status": r["status"], "count": r["count"], "root_hash": r["root_hash"], "signature": body["signature"], "body": json.dumps(body)})
            schema = pa.schema([(k, pa.int64() if k == "count" else pa.string()) for k in ("stream_id", "attestation_id", "status", "count", "root_hash", "signature", "body")])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ship(records.sparkSession)
    return found.mapInArrow(sign, "stream_id string, attestation_id string, status string, count long, root_hash string, signature string, body string")


def attestation_ok(attestation: dict) -> bool:
    """Whether an attestation's signature is right under the key that it names."""
    signed = {k: attestation[k] for k in SIGNED_FIELDS if k in attestation}
    key = base64.b64decode(attestation["signer"]["public_key"])
    return ed25519.verify(key, canonical_json(signed, "node"), base64.b64decode(attestation["signature"]))
