"""The engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.hashing import blake3_hex, canonical_payload, entry_hash, signature_ok
from ledgerloom.runtime import ship


def register(spark: SparkSession) -> None:
    """entry_hash, blake3_hex, canonical_json (struct of canonical and error) and signature_ok, for spark.sql."""
    ship(spark)
    for name, f in (("entry_hash", entry_hash), ("blake3_hex", blake3_hex), ("canonical_json", canonical_payload()), ("signature_ok", signature_ok)):
        spark.udf.register(name, f)


def register_ledger(ledger: DataFrame, name: str = "ledger") -> None:
    """A ledger and its findings as views: name and name_findings."""
    from ledgerloom.operators.verify import cli_findings

    ledger.createOrReplaceTempView(name)
    cli_findings(ledger).createOrReplaceTempView(f"{name}_findings")
