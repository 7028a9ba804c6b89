"""Arrow-batched hashing and signatures: the only Python in the ledger's plans."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from ledgerloom.functions import blake3, ed25519
from ledgerloom.functions.canonical import CanonicalError, canonical_json

# Types as objects: executors import this module, where no session can parse their names.
_CANONICAL = StructType().add("canonical", StringType()).add("error", StringType())
_HASHED = StructType().add("hash", StringType()).add("error", StringType())


def entry_preimage(seq: int, ts_ns: int, prev_hash: str, payload_hash: str) -> bytes:
    """What an entry hash covers: two little-endian 64-bit integers and the two hash texts."""
    return struct.pack("<Qq", seq & (1 << 64) - 1, ts_ns) + prev_hash.encode() + payload_hash.encode()


@F.pandas_udf(StringType())
def entry_hash(seq: pd.Series, ts_ns: pd.Series, prev_hash: pd.Series, payload_hash: pd.Series) -> pd.Series:
    """BLAKE3 entry hash in hex; null if any input is."""
    rows = list(zip(seq, ts_ns, prev_hash, payload_hash, strict=True))
    there = [k for k, r in enumerate(rows) if not any(pd.isna(x) for x in r)]
    out: list[str | None] = [None] * len(rows)
    for k, d in zip(there, blake3.digest_many([entry_preimage(int(rows[k][0]), int(rows[k][1]), rows[k][2], rows[k][3]) for k in there]), strict=True):
        out[k] = d.hex()
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def blake3_hex(value: pd.Series) -> pd.Series:
    """BLAKE3 of a text's UTF-8 bytes, in hex."""
    there = [k for k, x in enumerate(value) if not pd.isna(x)]
    out: list[str | None] = [None] * len(value)
    for k, d in zip(there, blake3.digest_many([value.iloc[k].encode() for k in there]), strict=True):
        out[k] = d.hex()
    return pd.Series(out, dtype=object)


def canonical_payload(profile: str = "sdk"):
    """A function of raw JSON text: struct of canonical text and error (one of them null)."""

    @F.pandas_udf(_CANONICAL)
    def run(raw: pd.Series) -> pd.DataFrame:
        out = []
        for text in raw:
            try:
                out.append((None, None) if pd.isna(text) else (canonical_json(json.loads(text), profile).decode("utf-8", "surrogatepass"), None))
            except (ValueError, CanonicalError, RecursionError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["canonical", "error"])

    return run


def payload_hash(raw: Column, algorithm: Column, profile: str = "sdk") -> Column:
    """Struct of hash (hex) and error. Algorithm blake3, or sha256, which unknown ones mean too."""

    @F.pandas_udf(_HASHED)
    def run(text: pd.Series, alg: pd.Series) -> pd.DataFrame:
        hashes: list[str | None] = [None] * len(text)
        errors: list[str | None] = [None] * len(text)
        late, data = [], []
        for k, (t, a) in enumerate(zip(text, alg, strict=True)):
            if pd.isna(t):
                continue
            try:
                canonical = canonical_json(json.loads(t), profile)
            except (ValueError, CanonicalError, RecursionError) as e:
                errors[k] = str(e)
                continue
            if a == "blake3":
                late.append(k)
                data.append(canonical)
            else:
                hashes[k] = hashlib.sha256(canonical).hexdigest()
        for k, d in zip(late, blake3.digest_many(data), strict=True):
            hashes[k] = d.hex()
        return pd.DataFrame({"hash": pd.Series(hashes, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(raw, algorithm)


def _key(text: str) -> bytes:
    """A public key from 64 hex digits, or from base64 of 32 bytes."""
    import base64

    return bytes.fromhex(text) if len(text) == 64 else base64.b64decode(text, validate=True)


@F.pandas_udf(BooleanType())
def signature_ok(public_key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether a signature (hex, or base64 of 64 bytes) over a text is right; malformed ones are not; null if any input is."""
    import base64

    out: list[bool | None] = []
    for k, m, s in zip(public_key, message, signature, strict=True):
        if pd.isna(k) or pd.isna(m) or pd.isna(s):
            out.append(None)
            continue
        try:
            raw = bytes.fromhex(s) if len(s) == 128 else base64.b64decode(s, validate=True)
            out.append(ed25519.verify(_key(k), m.encode(), raw))
        except ValueError:
            out.append(False)
    return pd.Series(out, dtype=object)


def signer(seed: bytes):
    """A function of texts: their signatures under a seed, in hex."""

    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if pd.isna(x) else ed25519.sign(seed, x.encode()).hex() for x in part], dtype=object)

    return run
