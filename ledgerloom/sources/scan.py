"""Log directories as a ledger DataFrame: one row per line, with its place, its fields, or why it cannot be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.expressions import any_to_ns, iso_to_ns

SIDE_FILES = ("receipts.jsonl", "dead_letters.jsonl", "sync_state.jsonl")
#: Canonical names and the names that mean the same.
ALIASES = {
    "sequence": ("sequence", "seq"),
    "timestamp": ("timestamp_ns", "ts_ns", "ts", "timestamp", "ts_client"),
    "prev_hash": ("prev_hash", "previous_hash", "prev"),
    "payload_hash": ("payload_hash", "hash", "event_hash"),
    "signature": ("signature", "sig", "sig_client"),
    "public_key": ("public_key", "pubkey", "pk"),
}
PLAIN = ("format_version", "event_type", "source", "key_id", "event_id", "stream_id", "hash_alg")
RECEIPT = "struct<event_id:string,payload_hash:string,server_time:string,server_seq:bigint,receipt_sig:string,server_key_id:string,sig_alg:string,batch_id:string>"
_FIELDS = sorted({a for names in ALIASES.values() for a in names} | set(PLAIN))
_SCHEMA = ", ".join([*(f"`{f}` string" for f in _FIELDS), f"receipt {RECEIPT}", "__bad string"])
#: Keys without which a record of profile sdk is rejected.
SDK_REQUIRED = ("event_id", "stream_id", "sequence", "prev_hash", "ts_client_raw", "payload", "payload_hash", "hash_alg", "signature", "key_id")


def read_lines(spark: SparkSession, path: str, profile: str = "cli", glob: str | None = None) -> DataFrame:
    """segment, line_no (from 1), line of all non-blank lines of a directory's segments (not of folders below it).

    Profile cli_strict reads the side files as segments too; sdk reads segment_*.jsonl; node segment_current.jsonl.
    """
    pattern = glob or {"sdk": "segment_*.jsonl", "node": "segment_current.jsonl"}.get(profile, "*.{wal,jsonl}")
    text = spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path)
    rows = text.select(F.col("_metadata.file_name").alias("segment"), F.col("_metadata.file_size").alias("segment_bytes"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    # a segment may be read by many tasks: lines are numbered within their split, and splits get the number of lines before them
    splits = rows.groupBy("segment", "__block").agg(F.min("__id").alias("__least"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("segment").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("segment", "__block", "__least", before.alias("__before")), ["segment", "__block"])
    if profile != "cli_strict":
        numbered = numbered.filter(~F.col("segment").isin(*SIDE_FILES))
    line_no = (F.col("__before") + F.col("__id") - F.col("__least") + 1).cast("long")
    return numbered.filter(F.regexp_replace("value", r"\s", "") != "").select("segment", "segment_bytes", line_no.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))


def parse_entries(lines: DataFrame, profile: str = "cli") -> DataFrame:
    """The ledger: a row per line, parse_error set where a line is no entry.

    Of a field's names at most one may be there. Sequences above 2^63 - 1 are parse errors. profile node keeps milliseconds, sdk
    microseconds, others nanoseconds.
    """
    parsed = lines.withColumn("j", F.from_json("line", _SCHEMA, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))
    get = lambda f: F.col(f"j.`{f}`")
    one = {name: F.coalesce(*map(get, names)) for name, names in ALIASES.items()}
    twice = F.lit(False)
    for names in ALIASES.values():
        twice = twice | (sum((get(a).isNotNull().cast("int") for a in names[1:]), get(names[0]).isNotNull().cast("int")) > 1)
    sequence = F.when(one["sequence"].rlike(r"^\d{1,19}$"), one["sequence"].try_cast("long"))
    digits = {"node": 3, "sdk": 6}.get(profile, 9)
    ts = any_to_ns(one["timestamp"]) if digits == 9 else iso_to_ns(one["timestamp"], digits)
    no = lambda name: F.lit(f"missing or malformed {name}")
    error = (
        F.when(F.col("j").isNull() | get("__bad").isNotNull() | ~F.ltrim("line").startswith("{"), "malformed JSON")
        .when(twice, "duplicate field")
        .when(sequence.isNull(), no("sequence"))
        .when(ts.isNull(), no("timestamp"))
        .when(one["prev_hash"].isNull(), no("prev_hash"))
        .when(one["payload_hash"].isNull(), no("payload_hash"))
    )
    payload = F.get_json_object("line", "$.payload")
    out = parsed.select(
        "segment", "segment_bytes", "line_no", error.alias("parse_error"),
        F.coalesce(get("format_version").try_cast("int"), F.lit(1)).alias("format_version"),
        sequence.alias("sequence"), ts.alias("timestamp_ns"), one["timestamp"].alias("ts_client_raw"),
        one["prev_hash"].alias("prev_hash"), one["payload_hash"].alias("payload_hash"), get("event_type").alias("event_type"), get("source").alias("source"),
        one["signature"].alias("signature"), one["public_key"].alias("public_key"), *[get(c).alias(c) for c in ("key_id", "event_id", "stream_id", "hash_alg")],
        payload.alias("payload"), get("receipt").alias("receipt"), "line",
    )
    if profile == "sdk":
        missing = F.lit(False)
        for c in SDK_REQUIRED:
            missing = missing | F.col(c).isNull()
        out = out.withColumn("parse_error", F.coalesce("parse_error", F.when(missing, "missing required field")))
    return out


def read_ledger(spark: SparkSession, path: str, profile: str = "cli") -> DataFrame:
    return parse_entries(read_lines(spark, path, profile), profile)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in an order."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def read_side(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a side file with their line_no; malformed lines are skipped, a missing file has none."""
    lines = read_lines(spark, path, "cli_strict", glob=name)
    return lines.select("line_no", F.from_json("line", schema).alias("j")).filter("j IS NOT NULL").select("line_no", "j.*")


def read_receipts(spark: SparkSession, path: str, event_ids: DataFrame | None = None) -> DataFrame:
    """The last well-formed receipt of each event: event_id, receipt, attached_at."""
    rows = read_side(spark, path, "receipts.jsonl", f"event_id string, receipt {RECEIPT}, attached_at string")
    rows = rows.filter("event_id IS NOT NULL AND receipt.event_id IS NOT NULL AND receipt.payload_hash IS NOT NULL AND receipt.receipt_sig IS NOT NULL")
    if event_ids is not None:
        rows = rows.join(event_ids.select("event_id"), "event_id", "left_semi")
    return latest(rows, "event_id", "line_no").select("event_id", "receipt", "attached_at")


def read_synced_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_side(spark, path, "receipts.jsonl", "event_id string").filter("event_id IS NOT NULL").select("event_id").distinct()


def read_dead_letter_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_side(spark, path, "dead_letters.jsonl", "event_id string").filter("event_id IS NOT NULL").select("event_id").distinct()


def iter_records(spark: SparkSession, path: str, stream_id: str | None = None) -> DataFrame:
    """Well-formed records in file order's columns, each with its latest receipt (the receipt log wins over an inline one)."""
    rows = read_ledger(spark, path, "sdk").filter("parse_error IS NULL")
    if stream_id is not None:
        rows = rows.filter(F.col("stream_id") == stream_id)
    receipts = read_receipts(spark, path).select("event_id", F.col("receipt").alias("__r"))
    return rows.join(receipts, "event_id", "left").withColumn("receipt", F.coalesce("__r", "receipt")).drop("__r")


def get_record(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """The first record with an id, with its receipt."""
    return iter_records(spark, path).filter(F.col("event_id") == event_id).orderBy("segment", "line_no").limit(1)


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The unsigned buffer: entries (seq, ts, event, segment, line_no), and the latest sync state of each seq."""
    entries = read_lines(spark, path, "cli_strict", glob="wal_*.jsonl").select("segment", "line_no", F.from_json("line", "seq long, ts string").alias("j"), F.get_json_object("line", "$.event").alias("event"))
    entries = entries.filter("j.seq IS NOT NULL AND j.ts IS NOT NULL AND event IS NOT NULL").select("segment", "line_no", "j.*", "event")
    states = read_side(spark, path, "sync_state.jsonl", "seq long, synced boolean, sync_attempts int, last_sync_error string, ts string").filter("seq IS NOT NULL")
    return entries, latest(states, "seq", "line_no")


def read_attestation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def present(column: Column) -> Column:
    return column.isNotNull()
