"""Statistics and lookups over a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import GENESIS, ns_to_rfc3339, shortened
from ledgerloom.operators.verify import with_entry_hash
from ledgerloom.plans.global_lag import previous_in


def wal_stats(ledger: DataFrame, order: tuple[str, ...] = ("segment", "line_no"), by: str | None = None) -> DataFrame:
    """Counts, first and last in file order, signatures, streams, receipts, and whether the chain is intact; per by, or for all."""
    keys = [by] if by else []
    rows = ledger if "entry_hash" in ledger.columns else with_entry_hash(ledger)
    rows = previous_in(rows, keys, list(order), ["entry_hash"])
    rows = rows.withColumn("__linked", F.col("prev_hash") == F.coalesce("prev_entry_hash", F.lit(GENESIS)))
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_events"),
        F.min_by("sequence", place).alias("first_sequence"), F.max_by("sequence", place).alias("last_sequence"),
        F.min_by("timestamp_ns", place).alias("first_timestamp_ns"), F.max_by("timestamp_ns", place).alias("last_timestamp_ns"),
        F.coalesce(F.bool_or(F.col("signature").isNotNull()), F.lit(False)).alias("has_signatures"),
        F.coalesce(F.bool_and("__linked"), F.lit(True)).alias("chain_intact"),
        F.coalesce(F.bool_or(F.col("event_id").isNotNull() | F.col("stream_id").isNotNull()), F.lit(False)).alias("is_sdk_format"),
        F.sort_array(F.collect_set("stream_id")).alias("stream_ids"),
        F.count_if(F.col("receipt").isNotNull()).alias("events_with_receipt"), F.count_if(F.col("receipt").isNull()).alias("events_without_receipt"),
    )


def segment_stats(ledger: DataFrame) -> DataFrame:
    """segment_count and total_size_bytes of the files a ledger was read from."""
    files = ledger.select("segment", "segment_bytes").distinct()
    return files.agg(F.count("*").alias("segment_count"), F.coalesce(F.sum("segment_bytes"), F.lit(0)).alias("total_size_bytes"))


def last_events(ledger: DataFrame, n: int = 10, order: tuple[str, ...] = ("segment", "line_no")) -> DataFrame:
    """The last n rows in file order, ascending; 0 gives none."""
    return ledger.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def find_sequence(ledger: DataFrame, sequence: int, order: tuple[str, ...] = ("segment", "line_no")) -> DataFrame:
    """The first row with a sequence number."""
    return ledger.filter(F.col("sequence") == sequence).orderBy(*order).limit(1)


def display(ledger: DataFrame) -> DataFrame:
    """What an event listing shows: strings, shortened hashes."""
    return ledger.select(F.col("sequence").cast("string").alias("sequence"), ns_to_rfc3339(F.col("timestamp_ns")).alias("timestamp"), F.coalesce("event_type", F.lit("-")).alias("event_type"), F.coalesce("source", F.lit("-")).alias("source"), shortened(F.col("payload_hash")).alias("payload_hash"), F.when(F.col("signature").isNotNull(), "yes").otherwise("no").alias("signed"), F.when(F.col("receipt").isNotNull(), "yes").otherwise("no").alias("receipt"))
