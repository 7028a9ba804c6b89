"""Receipts, dead letters, what is still to be sent, retention and the legacy buffer: all as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import delete_path, written
from ledgerloom.sources.scan import latest, read_dead_letter_ids, read_ledger, read_synced_ids

# HTTP status codes by what a sender does about them.
TRANSIENT, FATAL = (429, 500, 502, 503, 504), (400, 401, 403, 413, 422)


def with_receipts(records: DataFrame, receipts: DataFrame) -> DataFrame:
    """records with the latest receipt (receipts: event_id, receipt)."""
    return records.join(receipts.select("event_id", F.col("receipt").alias("latest_receipt")), "event_id", "left")


def unsynced(records: DataFrame, synced: DataFrame, dead: DataFrame) -> DataFrame:
    """records with neither a receipt nor a dead letter; a null event_id stays."""
    return records.join(synced.select("event_id"), "event_id", "left_anti").join(dead.select("event_id"), "event_id", "left_anti")


def first_unsynced(records: DataFrame, synced: DataFrame, dead: DataFrame, limit: int, order: tuple[str, ...] = ("segment", "line_no")) -> DataFrame:
    return unsynced(records, synced, dead).orderBy(*order).limit(limit)


def receipts_of(receipts: DataFrame, events: DataFrame) -> DataFrame:
    return receipts.join(events.select("event_id"), "event_id", "left_semi")


def substituted(records: DataFrame, receipts: DataFrame) -> DataFrame:
    """Records whose receipt names another event or payload (receipts: event_id, receipt)."""
    both = with_receipts(records, receipts).filter("latest_receipt IS NOT NULL")
    return both.filter(~F.col("latest_receipt.event_id").eqNullSafe(F.col("event_id")) | ~F.col("latest_receipt.payload_hash").eqNullSafe(F.col("payload_hash")))


def receipt_rows(events: DataFrame, at: Column) -> DataFrame:
    """Rows to append to a receipt log (events: event_id, receipt)."""
    return events.select("event_id", "receipt", at.alias("attached_at"))


def dead_letter_rows(events: DataFrame, at: Column, code: Column, reason: Column) -> DataFrame:
    """Rows to append to a dead-letter log."""
    return events.select("event_id", at.alias("failure_ts"), code.cast("int").alias("code"), reason.alias("reason"))


def classify_responses(responses: DataFrame) -> DataFrame:
    """responses (event_id, code) with action: receipt for 2xx, retry for transient codes, dead_letter for fatal ones, else stop."""
    code = F.col("code")
    return responses.withColumn("action", F.when(code.between(200, 299), "receipt").when(code.isin(*TRANSIENT), "retry").when(code.isin(*FATAL), "dead_letter").otherwise("stop"))


def retention_plan(segments: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """segments (segment named segment_YYYYmmdd_HHMMSS…) with expired: older than hours, but never the last one; other names stay."""
    stamp = F.regexp_extract("segment", r"^segment_(\d{8}_\d{6})", 1)
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
    last = segments.agg(F.max("segment").alias("__last"))
    rows = segments.crossJoin(F.broadcast(last))  # one row
    return rows.select(*segments.columns, F.coalesce((at < now - F.expr(f"interval {hours} hours")) & (F.col("segment") != F.col("__last")), F.lit(False)).alias("expired"))


def apply_retention(spark: SparkSession, path: str, now: Column, hours: int = 72) -> tuple[int, int]:
    """Deletes the expired segments of a directory; the numbers of removed and of kept ones. A row per file reaches the driver."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("segment_") and x.getPath().getName().endswith(".jsonl")]
    if not names:
        return 0, 0
    plan = retention_plan(spark.createDataFrame([(n,) for n in names], "segment string"), now, hours)
    gone = [r["segment"] for r in plan.filter("expired").collect()]
    for name in gone:
        delete_path(spark, f"{path.rstrip('/')}/{name}")
    return len(gone), len(names) - len(gone)


def log_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row about a log directory: streams, last sequence, segments, bytes, receipts, unsynced and dead events."""
    records = read_ledger(spark, path, "sdk").filter("parse_error IS NULL")
    synced, dead = read_synced_ids(spark, path), read_dead_letter_ids(spark, path)
    files = records.select("segment", "segment_bytes").distinct().agg(F.count("*").alias("segment_count"), F.coalesce(F.sum("segment_bytes"), F.lit(0)).alias("total_size_bytes"))
    facts = records.agg(F.countDistinct("stream_id").alias("streams"), F.coalesce(F.max("sequence"), F.lit(0)).alias("seq"), F.count("*").alias("events"))
    out = facts.crossJoin(files)  # one row each, here and below
    out = out.crossJoin(synced.agg(F.count("*").alias("receipts_count"))).crossJoin(dead.agg(F.count("*").alias("dead_letter_count")))
    return out.crossJoin(unsynced(records, synced, dead).agg(F.count("*").alias("unsynced_count")))


def sync_batch(records: DataFrame, send: Callable[[DataFrame], DataFrame], at: Column, attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sends records and says what to append: (receipt rows, dead-letter rows, records left over for the next batch).

    send: from records to (event_id, code, receipt, reason), lazily. Transient answers are sent again, up to attempts times in all; a
    code that is neither success, transient nor fatal stops its record for this batch. Every round's answers are a written table, so a
    lost executor does not send twice. For a stream, call it in foreachBatch; left-over records are the fallback.
    """
    spark = records.sparkSession
    now, answers = records, []
    for _ in range(attempts):
        answer = written(spark, classify_responses(send(now)), "answers")
        answers.append(answer)
        now = now.join(answer.filter("action = 'retry'").select("event_id"), "event_id", "left_semi")
        if now.isEmpty():
            break
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    done = every.filter("action IN ('receipt', 'dead_letter')").select("event_id")
    receipts = receipt_rows(every.filter("action = 'receipt'"), at)
    dead = every.filter("action = 'dead_letter'")
    return receipts, dead_letter_rows(dead, at, F.col("code"), F.col("reason")), records.join(done, "event_id", "left_anti")


def first_by_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The first event of each idempotency key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


# The legacy, unsigned buffer


def compact_states(states: DataFrame, order: str = "line_no") -> DataFrame:
    """The last state of each seq."""
    return latest(states, "seq", order)


def buffer_status(entries: DataFrame, states: DataFrame) -> DataFrame:
    """entries with synced and sync_attempts; entries without a state are unsynced."""
    now = states.select("seq", F.col("synced").alias("__s"), F.col("sync_attempts").alias("__a"))
    return entries.join(now, "seq", "left").withColumn("synced", F.coalesce("__s", F.lit(False))).withColumn("sync_attempts", F.coalesce("__a", F.lit(0))).drop("__s", "__a")


def buffer_stats(entries: DataFrame, states: DataFrame) -> DataFrame:
    return buffer_status(entries, states).agg(F.count("*").alias("total"), F.count_if("synced").alias("synced"), F.count_if(~F.col("synced")).alias("pending"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def states_in_range(states: DataFrame, entries: DataFrame) -> DataFrame:
    """States of sequences that the entries' range still covers."""
    bounds = entries.agg(F.min("seq").alias("__lo"), F.max("seq").alias("__hi"))
    return states.crossJoin(F.broadcast(bounds)).filter(F.col("seq").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row


def to_retry(entries: DataFrame, states: DataFrame, max_retries: int = 3) -> DataFrame:
    return buffer_status(entries, states).filter(~F.col("synced") & (F.col("sync_attempts") < max_retries))


def removable_files(entries: DataFrame, states: DataFrame, max_files: int = 100) -> DataFrame:
    """Files beyond the newest max_files whose entries are all synced."""
    files = buffer_status(entries, states).groupBy("segment").agg(F.bool_and("synced").alias("done"))
    newest = files.orderBy(F.col("segment").desc()).limit(max_files).select("segment")
    return files.join(newest, "segment", "left_anti").filter("done").select("segment")
