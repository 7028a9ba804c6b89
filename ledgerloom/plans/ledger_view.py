"""The events table as a ledger with planted faults, by the same formulas in Spark and in SQL.

Links are stand-ins made by SHA-256 (an entry hash proper is BLAKE3): a row's link is the hash of its stream and sequence, so SQL can
check everything that follows. Faults: every 97th event is dropped after numbering, every 101st is a day early, every 89th has another
payload than was hashed, every 103rd names a wrong predecessor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.expressions import GENESIS, stream_id
from ledgerloom.runtime import table
from ledgerloom.sources.scan import RECEIPT

DAY_NS = 86_400_000_000_000


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events.select("event_id", "user_id", "event_type", "us", F.row_number().over(w).cast("long").alias("sequence")).filter("event_id % 97 <> 0")
    rows = rows.withColumn("stream_id", stream_id(F.col("user_id").cast("string"), F.lit("")))
    payload = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    link = lambda n: F.sha2(F.concat(F.col("stream_id"), F.lit(":"), n.cast("string")), 256)
    return rows.select(
        "event_id", "user_id", "stream_id", "sequence",
        (F.col("us") * 1000 - F.when(F.col("event_id") % 101 == 0, DAY_NS).otherwise(0)).alias("timestamp_ns"),
        "event_type", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("event_id") % 89 == 0, F.lit('{"tampered":true}')).otherwise(payload).alias("payload"),
        F.sha2(payload, 256).alias("payload_hash"),
        F.when(F.col("event_id") % 103 == 0, F.lit("f" * 64)).when(F.col("sequence") == 1, F.lit(GENESIS)).otherwise(link(F.col("sequence") - 1)).alias("prev_hash"),
        link(F.col("sequence")).alias("entry_hash"),
        F.when(F.col("event_id") % 2 == 0, F.lit("ab" * 64)).alias("signature"), F.lit(None).cast("string").alias("public_key"),
        F.lit("sha256").alias("hash_alg"), F.lit(None).cast("string").alias("parse_error"), F.lit(None).cast(RECEIPT).alias("receipt"),
    )


def receipt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two receipts of each event that has any, in order; some name another event."""
    rows = ledger_view(spark, sf_dir).filter("event_id % 3 <> 0").select("event_id", "payload_hash", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("line_no")).withColumn("line_no", F.col("line_no").cast("long"))
    named = F.when((F.col("event_id") % 107 == 0) & (F.col("line_no") == 2), F.col("event_id") + 1).otherwise(F.col("event_id"))
    return rows.select("event_id", "line_no", F.struct(named.alias("event_id"), "payload_hash", (F.col("event_id") * 10 + F.col("line_no")).alias("server_seq")).alias("receipt"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 11 = 0").select("event_id")


LEDGER_SQL = """
WITH base AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events
), named AS (
  SELECT *, 'stream_' || left(sha256(user_id || ':default'), 16) AS stream_id,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS body
  FROM base WHERE event_id % 97 <> 0
), ledger AS (
  SELECT event_id, user_id, stream_id, sequence,
    us * 1000 - CASE WHEN event_id % 101 = 0 THEN 86400000000000 ELSE 0 END AS timestamp_ns,
    event_type, 'user_' || user_id AS source,
    CASE WHEN event_id % 89 = 0 THEN '{"tampered":true}' ELSE body END AS payload,
    sha256(body) AS payload_hash,
    CASE WHEN event_id % 103 = 0 THEN repeat('f', 64) WHEN sequence = 1 THEN repeat('0', 64) ELSE sha256(stream_id || ':' || (sequence - 1)) END AS prev_hash,
    sha256(stream_id || ':' || sequence) AS entry_hash,
    CASE WHEN event_id % 2 = 0 THEN repeat('ab', 64) END AS signature
  FROM named
), lagged AS (
  SELECT *, lag(sequence) OVER w AS prev_seq, lag(timestamp_ns) OVER w AS prev_ts, lag(entry_hash) OVER w AS prev_link
  FROM ledger WINDOW w AS (PARTITION BY stream_id ORDER BY sequence)
), receipts AS (
  SELECT event_id, line_no, CASE WHEN event_id % 107 = 0 AND line_no = 2 THEN event_id + 1 ELSE event_id END AS r_event_id, payload_hash AS r_payload_hash, event_id * 10 + line_no AS server_seq
  FROM ledger, (SELECT unnest([1, 2])::BIGINT AS line_no) WHERE event_id % 3 <> 0
), dead AS (SELECT event_id FROM events WHERE event_id % 11 = 0)
"""
