"""Audit events as they are sent: their JSON, payload signatures, sampling, and counters of a flow."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ledgerloom.functions import blake3, ed25519
from ledgerloom.functions.canonical import CanonicalError, canonical_json

_SERIALIZED = StructType().add("json", StringType()).add("error", StringType())
_SIGNED = StructType().add("payload_hash", StringType()).add("signature", StringType()).add("hash_alg", StringType()).add("error", StringType())
#: Fields of a request body that are left out when null or empty; the others are always there.
OPTIONAL = ("actor", "resource", "source")


def request_bodies(events: DataFrame) -> DataFrame:
    """events (event_type, payload as JSON text, severity, timestamp, idempotency_key; actor and resource as JSON text, source) with body:
    struct of json (sorted keys, no blanks, null parts left out) and error (why a payload cannot be sent: a float, or no JSON)."""

    @F.pandas_udf(_SERIALIZED)
    def run(kind: pd.Series, payload: pd.Series, severity: pd.Series, at: pd.Series, key: pd.Series, actor: pd.Series, resource: pd.Series, source: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(kind, payload, severity, at, key, actor, resource, source, strict=True):
            kind_, text, severity_, at_, key_, *parts = (None if pd.isna(x) else x for x in row)
            try:
                value = json.loads(text) if text is not None else None
                canonical_json(value)
                body = {"event_type": kind_, "payload": value, "severity": severity_, "timestamp": at_, "idempotency_key": key_}
                for name, part in zip(OPTIONAL, parts, strict=True):
                    if part:
                        body[name] = part if name == "source" else {k: v for k, v in json.loads(part).items() if v is not None}
                out.append((json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None))
            except (ValueError, CanonicalError, RecursionError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["json", "error"])

    there = {c: F.col(c) if c in events.columns else F.lit(None).cast("string") for c in OPTIONAL}
    return events.withColumn("body", run("event_type", "payload", "severity", "timestamp", "idempotency_key", *there.values()))


def sign_payloads(payload: Column, seed: bytes) -> Column:
    """Struct of payload_hash, signature (hex, over the canonical payload), hash_alg, and error."""

    @F.pandas_udf(_SIGNED)
    def run(texts: pd.Series) -> pd.DataFrame:
        forms: list[bytes | None] = []
        errors: list[str | None] = []
        for t in texts:
            try:
                forms.append(None if pd.isna(t) else canonical_json(json.loads(t)))
                errors.append(None)
            except (ValueError, CanonicalError, RecursionError) as e:
                forms.append(None)
                errors.append(str(e))
        there = [k for k, x in enumerate(forms) if x is not None]
        rows: list[tuple] = [(None, None, None, e) for e in errors]
        for k, d in zip(there, blake3.digest_many([forms[k] for k in there]), strict=True):
            rows[k] = (d.hex(), ed25519.sign(seed, forms[k]).hex(), "blake3", None)
        return pd.DataFrame(rows, columns=["payload_hash", "signature", "hash_alg", "error"])

    return run(payload)


def payload_signature_ok(payload: Column, signature: Column, public_key: Column) -> Column:
    """Whether a signature over a payload's canonical form is right; malformed ones are not; null if any input is."""

    @F.pandas_udf(BooleanType())
    def run(texts: pd.Series, signatures: pd.Series, keys: pd.Series) -> pd.Series:
        out: list[bool | None] = []
        for t, s, k in zip(texts, signatures, keys, strict=True):
            if pd.isna(t) or pd.isna(s) or pd.isna(k):
                out.append(None)
                continue
            try:
                out.append(ed25519.verify(bytes.fromhex(k), canonical_json(json.loads(t)), bytes.fromhex(s)))
            except (ValueError, CanonicalError, RecursionError):
                out.append(False)
        return pd.Series(out, dtype=object)

    return run(payload, signature, public_key)


def sample_level(events: DataFrame, key: str, level: str = "level", sampled: str = "debug", percent: int = 10) -> DataFrame:
    """events without all but percent of those of one level, by a hash of their key: the same ones in every run."""
    place = F.conv(F.substr(F.md5(F.col(key).cast("string")), F.lit(1), F.lit(6)), 16, 10).cast("long") % 100
    return events.filter((F.lower(level) != sampled) | F.col(level).isNull() | (place < percent))


def observed(events: DataFrame, name: str = "flow", time: str = "timestamp_ns", failed: Column | None = None) -> tuple[DataFrame, Observation]:
    """events and an Observation of received, failed, and last_ns (the high-water mark), filled when an action has run."""
    seen = Observation(name)
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return events.observe(seen, F.count(F.lit(1)).alias("received"), F.count_if(bad).alias("failed"), F.max(time).alias("last_ns")), seen
