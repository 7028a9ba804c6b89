"""The queries of the ledger operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ed25519
from ledgerloom.functions import expressions as E
from ledgerloom.functions.hashing import blake3_hex, canonical_payload, entry_hash, payload_hash, signature_ok, signer
from ledgerloom.operators import append, attest, events, export, inspect, report, sync, verify
from ledgerloom.operators.root import chain_root
from ledgerloom.plans.global_lag import with_previous
from ledgerloom.plans.ledger_view import LEDGER_SQL, dead_letters, ledger_view, receipt_log
from ledgerloom.runtime import scratch_path, ship, table, written
from ledgerloom.sources.keys import key_table
from ledgerloom.sources.scan import RECEIPT, latest, read_ledger, read_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ("stream_id", "sequence")
#: The seed of RFC 8032's first test: these queries' signing key.
SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")


def query(sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Registers a query; sql follows the ledger's SQL unless plain."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if plain else LEDGER_SQL + sql
        return f

    return add


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.cli_findings(ledger_view(spark, sf_dir), stream="stream_id", order=("sequence",), check_payload=False)


def _of(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _findings(spark, sf_dir).filter(F.col("error_type") == kind).select("stream_id", "sequence", "details")


# Views, hashes, verification


@query("SELECT event_id, user_id, stream_id, sequence, timestamp_ns, event_type, source, payload, payload_hash, prev_hash, entry_hash FROM ledger")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_view(spark, sf_dir).select("event_id", "user_id", "stream_id", "sequence", "timestamp_ns", "event_type", "source", "payload", "payload_hash", "prev_hash", "entry_hash")


@query("SELECT event_id, sha256(payload) AS computed, payload_hash AS stored FROM ledger WHERE sha256(payload) <> payload_hash")
def payload_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).withColumn("p", payload_hash(F.col("payload"), F.col("hash_alg")))
    return rows.filter("p.hash <> payload_hash").select("event_id", F.col("p.hash").alias("computed"), F.col("payload_hash").alias("stored"))


@query("SELECT stream_id, sequence, 'Sequence gap: missing ' || (prev_seq + 1) || ' after ' || prev_seq AS details FROM lagged WHERE sequence <> prev_seq + 1")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of("sequence_gap")(spark, sf_dir)


@query('SELECT stream_id, coalesce(prev_seq, 0) + 1 AS "from", sequence - 1 AS "to" FROM lagged WHERE sequence <> coalesce(prev_seq, 0) + 1')
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("sequence", 1, 0).over(Window.partitionBy("stream_id").orderBy("sequence"))
    rows = ledger_view(spark, sf_dir).select("stream_id", "sequence", before.alias("before")).filter("sequence <> before + 1")
    return rows.select("stream_id", (F.col("before") + 1).alias("from"), (F.col("sequence") - 1).alias("to"))


@query("SELECT stream_id, sequence, 'Timestamp regression at sequence ' || sequence || ': ' || prev_ts || ' -> ' || timestamp_ns AS details FROM lagged WHERE timestamp_ns < prev_ts")
def timestamp_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of("timestamp_regression")(spark, sf_dir)


@query("SELECT stream_id, sequence, 'Chain break at sequence ' || sequence || ': expected ' || prev_link || ', found ' || prev_hash AS details FROM lagged WHERE prev_hash <> prev_link")
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of("chain_break")(spark, sf_dir)


@query("""SELECT stream_id, sequence, 'Invalid genesis: prev_hash should be sequence=1, prev_hash=' || repeat('0', 16) || ', found sequence=' || sequence AS details FROM lagged WHERE prev_seq IS NULL AND sequence <> 1
UNION ALL SELECT stream_id, sequence, 'Invalid genesis: prev_hash should be ' || repeat('0', 64) || ', found ' || prev_hash FROM lagged WHERE prev_seq IS NULL AND prev_hash <> repeat('0', 64)""")
def genesis_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of("invalid_genesis")(spark, sf_dir)


@query("""SELECT error_type, count(*) AS n FROM (
  SELECT 'sequence_gap' AS error_type FROM lagged WHERE sequence <> prev_seq + 1
  UNION ALL SELECT 'timestamp_regression' FROM lagged WHERE timestamp_ns < prev_ts
  UNION ALL SELECT 'chain_break' FROM lagged WHERE prev_hash <> prev_link
  UNION ALL SELECT 'invalid_genesis' FROM lagged WHERE prev_seq IS NULL AND sequence <> 1
  UNION ALL SELECT 'invalid_genesis' FROM lagged WHERE prev_seq IS NULL AND prev_hash <> repeat('0', 64)
  UNION ALL SELECT 'rows' FROM ledger) GROUP BY 1""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).agg(F.lit("rows").alias("error_type"), F.count("*").alias("n"))
    return _findings(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n")).unionByName(rows)


_ALL_FINDINGS = """
  SELECT stream_id, sequence, 1 AS rank, 'invalid_genesis' AS error_type FROM lagged WHERE prev_seq IS NULL AND sequence <> 1
  UNION ALL SELECT stream_id, sequence, 2, 'invalid_genesis' FROM lagged WHERE prev_seq IS NULL AND prev_hash <> repeat('0', 64)
  UNION ALL SELECT stream_id, sequence, 3, 'chain_break' FROM lagged WHERE prev_hash <> prev_link
  UNION ALL SELECT stream_id, sequence, 4, 'sequence_gap' FROM lagged WHERE sequence <> prev_seq + 1
  UNION ALL SELECT stream_id, sequence, 5, 'timestamp_regression' FROM lagged WHERE timestamp_ns < prev_ts"""


@query(f"SELECT stream_id, sequence, error_type FROM ({_ALL_FINDINGS}) ORDER BY stream_id, sequence, rank LIMIT 1")
def fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.first_finding(_findings(spark, sf_dir), ("stream_id", "sequence")).select("stream_id", "sequence", "error_type")


@query(f"SELECT stream_id, sequence, error_type FROM ({_ALL_FINDINGS}) ORDER BY stream_id, sequence, rank LIMIT 5")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.first_findings(_findings(spark, sf_dir), 5, ("stream_id", "sequence")).select("stream_id", "sequence", "error_type")


@query("""SELECT stream_id, sequence, count(*) AS n FROM (SELECT stream_id, sequence + CASE WHEN event_id % 109 = 0 THEN -1 ELSE 0 END AS sequence FROM ledger) GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).select("stream_id", (F.col("sequence") - F.when(F.col("event_id") % 109 == 0, 1).otherwise(0)).alias("sequence"))
    return rows.groupBy("stream_id", "sequence").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT event_id, sequence, lag(sequence) OVER (ORDER BY event_id) AS prev_sequence FROM ledger""")
def global_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_previous(ledger_view(spark, sf_dir).select("event_id", "sequence"), ["event_id"], ["sequence"])


@query(LEDGER_SQL.replace("WITH base", "WITH RECURSIVE base", 1) + """, numbered AS (SELECT stream_id, payload_hash, row_number() OVER (PARTITION BY stream_id ORDER BY sequence) AS k FROM ledger),
fold AS (
  SELECT stream_id, k, sha256(k || '|' || repeat('0', 64) || '|' || payload_hash) AS h FROM numbered WHERE k = 1
  UNION ALL SELECT n.stream_id, n.k, sha256(n.k || '|' || f.h || '|' || n.payload_hash) FROM numbered n JOIN fold f ON n.stream_id = f.stream_id AND n.k = f.k + 1
) SELECT stream_id, max(k) AS n, arg_max(h, k) AS root FROM fold GROUP BY 1""", plain=True)
def oracle_sha256_chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "payload_hash"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(E.GENESIS).alias("h"))
    step = lambda acc, x: F.struct((acc["k"] + 1).alias("k"), F.sha2(F.concat((acc["k"] + 1).cast("string"), F.lit("|"), acc["h"], F.lit("|"), x["payload_hash"]), 256).alias("h"))
    return rows.select("stream_id", F.aggregate("rows", start, step).alias("s")).select("stream_id", F.col("s.k").alias("n"), F.col("s.h").alias("root"))


# Statistics and lookups


_STATS = """count(*) AS total_events, arg_min(sequence, {o}) AS first_sequence, arg_max(sequence, {o}) AS last_sequence, arg_min(timestamp_ns, {o}) AS first_timestamp_ns, arg_max(timestamp_ns, {o}) AS last_timestamp_ns,
 bool_or(signature IS NOT NULL) AS has_signatures, bool_and(prev_hash = coalesce(prev_link, repeat('0', 64))) AS chain_intact"""


@query(f"SELECT {_STATS.format(o='(stream_id, sequence)')}, count(DISTINCT stream_id) AS n_streams FROM lagged")
def wal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = inspect.wal_stats(ledger_view(spark, sf_dir), order=("sequence",), by="stream_id")
    return by.agg(F.sum("total_events").alias("total_events"), *[f(c, "stream_id").alias(c) for c, f in (("first_sequence", F.min_by), ("last_sequence", F.max_by), ("first_timestamp_ns", F.min_by), ("last_timestamp_ns", F.max_by))], F.bool_or("has_signatures").alias("has_signatures"), F.bool_and("chain_intact").alias("chain_intact"), F.count("*").alias("n_streams"))


@query(f"SELECT stream_id, {_STATS.format(o='sequence')} FROM lagged GROUP BY 1")
def stats_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.wal_stats(ledger_view(spark, sf_dir), order=("sequence",), by="stream_id").select("stream_id", "total_events", "first_sequence", "last_sequence", "first_timestamp_ns", "last_timestamp_ns", "has_signatures", "chain_intact")


@query("SELECT DISTINCT stream_id FROM ledger")
def distinct_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_view(spark, sf_dir).select("stream_id").distinct()


@query("SELECT stream_id, sequence, event_id FROM ledger ORDER BY stream_id DESC, sequence DESC LIMIT 10")
def last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.last_events(ledger_view(spark, sf_dir), 10, ORDER).select("stream_id", "sequence", "event_id")


@query("SELECT stream_id, sequence, event_id FROM ledger WHERE sequence = 7 ORDER BY stream_id LIMIT 1")
def find_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.find_sequence(ledger_view(spark, sf_dir), 7, ORDER).select("stream_id", "sequence", "event_id")


_STAMP = """strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp_ns % 1000000000 = 0 THEN '' WHEN timestamp_ns % 1000000 = 0 THEN '.' || lpad((timestamp_ns % 1000000000 // 1000000)::VARCHAR, 3, '0') ELSE '.' || lpad((timestamp_ns % 1000000000 // 1000)::VARCHAR, 6, '0') END || '+00:00'"""


@query(f"""SELECT sequence::VARCHAR AS sequence, {_STAMP} AS "timestamp", event_type, source, left(payload_hash, 8) || '…' AS payload_hash, CASE WHEN signature IS NULL THEN 'no' ELSE 'yes' END AS signed, 'no' AS receipt FROM ledger""")
def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.display(ledger_view(spark, sf_dir))


# Exports

_RANGE = ("2024-01-02", "2024-01-10")


@query(f"""SELECT sequence, {_STAMP} AS "timestamp", event_type, source, payload_hash FROM ledger WHERE timestamp_ns BETWEEN epoch_us(TIMESTAMP '2024-01-02') * 1000 AND epoch_us(TIMESTAMP '2024-01-11') * 1000 - 1""")
def export_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_rows(export.in_range(ledger_view(spark, sf_dir), *_RANGE))


@query(f"""SELECT sequence || ',' || {_STAMP} || ',' || event_type || ',' || source || ',' || payload_hash AS "value" FROM ledger""")
def export_csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.csv_lines(export.export_rows(ledger_view(spark, sf_dir)))


@query(f"""SELECT '<14>1 ' || {_STAMP} || ' ledgerloom ' || source || ' - - - seq=' || sequence || ' hash=' || payload_hash AS "value" FROM ledger""")
def export_syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.syslog_lines(export.export_rows(ledger_view(spark, sf_dir)))


@query(f"""SELECT '{{"sequence":' || sequence || ',"timestamp":"' || {_STAMP} || '","event_type":"' || event_type || '","source":"' || source || '","payload_hash":"' || payload_hash || '","chain_proof":{{"prev_hash":"' || prev_hash || '","entry_hash":"' || entry_hash || '"' || CASE WHEN signature IS NULL THEN '' ELSE ',"signature":"' || signature || '"' END || '}}}}' AS "value" FROM ledger""")
def export_jsonl_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.jsonl_lines(export.export_rows(ledger_view(spark, sf_dir), proofs=True))


# Receipts and sending


@query("SELECT l.event_id, r.server_seq FROM ledger l LEFT JOIN (SELECT * FROM receipts WHERE line_no = 2) r USING (event_id)")
def receipt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.with_receipts(ledger_view(spark, sf_dir), latest(receipt_log(spark, sf_dir), "event_id", "line_no")).select("event_id", F.col("latest_receipt.server_seq").alias("server_seq"))


@query("SELECT event_id, server_seq FROM receipts WHERE line_no = 2")
def latest_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(receipt_log(spark, sf_dir), "event_id", "line_no").select("event_id", F.col("receipt.server_seq").alias("server_seq"))


@query("SELECT event_id, line_no FROM receipts WHERE event_id IN (SELECT event_id FROM dead)")
def requested_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.receipts_of(receipt_log(spark, sf_dir), dead_letters(spark, sf_dir)).select("event_id", "line_no")


@query("""SELECT CASE WHEN event_id % 3 <> 0 THEN 'receipt' ELSE 'missing' END AS status, count(*) AS n FROM ledger GROUP BY 1""")
def receipt_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sync.with_receipts(ledger_view(spark, sf_dir), latest(receipt_log(spark, sf_dir), "event_id", "line_no"))
    return rows.groupBy(F.when(F.col("latest_receipt").isNotNull(), "receipt").otherwise("missing").alias("status")).agg(F.count("*").alias("n"))


_PENDING = "FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.event_id = l.event_id) AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.event_id = l.event_id)"


@query(f"SELECT stream_id, sequence, event_id {_PENDING} ORDER BY stream_id, sequence LIMIT 100")
def unsynced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.first_unsynced(ledger_view(spark, sf_dir), receipt_log(spark, sf_dir), dead_letters(spark, sf_dir), 100, ORDER).select("stream_id", "sequence", "event_id")


@query(f"SELECT count(*) AS n {_PENDING}")
def unsynced_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.unsynced(ledger_view(spark, sf_dir), receipt_log(spark, sf_dir), dead_letters(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT event_id) AS n FROM dead")
def dead_letter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_letters(spark, sf_dir).agg(F.countDistinct("event_id").alias("n"))


@query("SELECT event_id FROM receipts WHERE line_no = 2 AND r_event_id <> event_id")
def receipt_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.substituted(ledger_view(spark, sf_dir), latest(receipt_log(spark, sf_dir), "event_id", "line_no")).select("event_id")


@query("""SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'receipt' WHEN code IN (429, 500, 502, 503, 504) THEN 'retry' WHEN code IN (400, 401, 403, 413, 422) THEN 'dead_letter' ELSE 'stop' END AS action
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 422 WHEN 3 THEN 429 ELSE 418 END AS code FROM ledger)""")
def response_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 503, 422, 429, 418))), (F.col("event_id") % 5 + 1).cast("int"))
    return sync.classify_responses(ledger_view(spark, sf_dir).select("event_id", code.alias("code"))).select("event_id", "action")


@query("SELECT event_id FROM ledger WHERE user_id % 7 = 0 AND timestamp_ns > epoch_us(TIMESTAMP '2024-01-15') * 1000")
def key_revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).withColumn("key_id", F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string"))).withColumn("ts_client_raw", E.ns_to_rfc3339(F.col("timestamp_ns")))
    gone = spark.createDataFrame([("k0", "2024-01-15T00:00:00+00:00")], "key_id string, valid_until string")
    return verify.revoked(rows, gone).select("event_id")


# Small functions over events


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'high' ELSE 'info' END AS by_level, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 3 = 1 THEN 'warning' ELSE 'info' END AS by_status,
 CASE event_id % 4 WHEN 0 THEN 'debug' WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS by_syslog FROM events""", plain=True)
def severity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", E.syslog_severity(F.col("event_type")).alias("by_level"), E.status_severity(pick((500, 404, 200))).alias("by_status"), E.syslog_severity(pick(("DEBUG", "emerg", "Warning", "other"))).alias("by_syslog"))


@query("""SELECT '{"original_log":{"event_id":' || event_id || ',"event_type":"' || event_type || '"},"forwarded_at":"2024-01-01T00:00:00+00:00"}' AS envelope FROM events""", plain=True)
def shadow_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_json(F.struct(F.struct("event_id", "event_type").alias("original_log"), F.lit("2024-01-01T00:00:00+00:00").alias("forwarded_at"))).alias("envelope"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'req:' || event_id ELSE 'req:' || left(sha256(event_type || ':' || user_id), 16) END AS key,
 'Host=x' || CASE WHEN event_id % 2 = 0 THEN ';Authorization=[REDACTED]' ELSE '' END AS headers FROM events""", plain=True)
def request_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    key = E.idempotency_key(F.when(even, F.col("event_id").cast("string")), F.col("event_type"), F.col("user_id").cast("string"))
    headers = F.when(even, F.create_map(*map(F.lit, ("Host", "x", "Authorization", "s", "Cookie", "c")))).otherwise(F.create_map(*map(F.lit, ("Host", "x", "Cookie", "c"))))
    kept = E.redact_headers(headers, ["host"], ["authorization"])
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"), F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2", plain=True)
def idempotent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return sync.first_by_key(rows, "key", "event_id").select("user_id", "event_type", "event_id")


@query("""SELECT event_id, unnest(list_filter([
  CASE WHEN length(p) <> 64 THEN 'prev_hash invalid length: expected 64 chars, got ' || length(p) WHEN regexp_matches(p, '[^0-9a-fA-F]') THEN 'prev_hash contains invalid char ''z'' at position 3' END,
  CASE WHEN length(h) <> 64 THEN 'payload_hash invalid length: expected 64 chars, got ' || length(h) END,
  CASE WHEN length(s) <> 128 THEN 'signature invalid length: expected 128 chars, got ' || length(s) WHEN regexp_matches(s, '[^0-9a-fA-F]') THEN 'signature contains invalid hex characters' END,
  CASE WHEN length(k) <> 64 THEN 'public_key invalid length: expected 64 chars, got ' || length(k) END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(prev_hash, 3) || 'z' || substr(prev_hash, 5) ELSE prev_hash END AS p, CASE WHEN event_id % 7 = 0 THEN left(payload_hash, 10) ELSE payload_hash END AS h,
  CASE WHEN event_id % 4 = 0 THEN replace(signature, 'a', 'x') ELSE signature END AS s, CASE WHEN event_id % 6 = 0 THEN 'abc' END AS k FROM ledger)""")
def hex_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    p = F.when(n % 5 == 0, F.concat(F.left("prev_hash", F.lit(3)), F.lit("z"), F.substr("prev_hash", F.lit(5)))).otherwise(F.col("prev_hash"))
    h = F.when(n % 7 == 0, F.left("payload_hash", F.lit(10))).otherwise(F.col("payload_hash"))
    s = F.when(n % 4 == 0, F.replace("signature", F.lit("a"), F.lit("x"))).otherwise(F.col("signature"))
    rows = ledger_view(spark, sf_dir).select("event_id", p.alias("p"), h.alias("h"), s.alias("s"), F.when(n % 6 == 0, "abc").alias("k"))
    return rows.select("event_id", F.explode(E.hash_problems(F.col("p"), F.col("h"), F.col("s"), F.col("k"))).alias("problem"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 1000 * 1000000 AS ms_ns FROM events", plain=True)
def timestamp_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", E.iso_to_ns(iso).alias("ns"), E.iso_to_ns(iso, 3).alias("ms_ns"))


@query("""SELECT doc_id, nfc_normalize(text) AS canonical FROM documents""", plain=True)
def nfc_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", canonical_payload()(raw).alias("c"))
    return rows.select("doc_id", F.get_json_object("c.canonical", "$.text").alias("canonical"))


# Reports


_ANALYSIS = """, facts AS (SELECT stream_id, count(*) AS total_events, count(signature) AS signatures_found, bool_and(prev_hash = coalesce(prev_link, repeat('0', 64))) AS intact,
  list(prev_seq + 1 ORDER BY sequence) FILTER (WHERE sequence <> prev_seq + 1) AS gaps, list(sequence ORDER BY sequence) FILTER (WHERE timestamp_ns < prev_ts) AS back FROM lagged GROUP BY 1),
checks AS (SELECT stream_id, total_events, CASE WHEN intact AND gaps IS NULL AND back IS NULL THEN 'PASS' ELSE 'FAIL' END AS overall_status,
  'Chain Integrity:' || CASE WHEN intact THEN 'PASS' ELSE 'FAIL' END || ';Sequence Continuity:' || CASE WHEN gaps IS NULL THEN 'PASS' ELSE 'FAIL' END || ';Timestamp Monotonicity:' || CASE WHEN back IS NULL THEN 'PASS' ELSE 'WARN' END || ';' AS basic, intact, signatures_found,
  CASE WHEN intact THEN 0 ELSE 1 END + CASE WHEN gaps IS NULL THEN 0 ELSE 1 END + CASE WHEN signatures_found = 0 THEN 1 ELSE 0 END AS r FROM facts)
SELECT stream_id, total_events, overall_status, basic || {own} AS checks, greatest(r, 1)::BIGINT AS n_recommendations FROM checks"""
_KEPT = "CASE WHEN intact THEN 'PASS' ELSE 'FAIL' END"
_OWN = {
    "dora": f"'DORA Art. 12 - ICT Logging:PASS;DORA Art. 12 - Integrity Protection:' || {_KEPT}",
    "nis2": f"'NIS2 Art. 21 - Security Measures:' || {_KEPT} || ';NIS2 Art. 23 - Incident Reporting:INFO'",
    "generic": "'Digital Signatures:' || CASE WHEN signatures_found > 0 THEN 'PASS' ELSE 'WARN' END",
}


def _report(template: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = report.report(ledger_view(spark, sf_dir), template, order=("sequence",), by="stream_id")
        checks = F.array_join(F.transform("checklist", lambda c: F.concat(c["requirement"], F.lit(":"), c["status"])), ";")
        return rows.select("stream_id", "total_events", "overall_status", checks.alias("checks"), F.size("recommendations").cast("long").alias("n_recommendations"))

    run.__name__ = f"compliance_report_{template}"
    return run


for _template in report.TEMPLATES:
    query(_ANALYSIS.format(own=_OWN[_template]))(_report(_template))


# The legacy buffer and retention


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("seq"), F.col("event_id").alias("line_no"), (F.col("event_id") % 3 == 0).alias("synced"), (F.col("event_id") % 5).cast("int").alias("sync_attempts"))


_LATEST = "latest AS (SELECT seq, arg_max(synced, line_no) AS synced, arg_max(attempts, line_no) AS attempts FROM (SELECT event_id % 500 AS seq, event_id AS line_no, event_id % 3 = 0 AS synced, event_id % 5 AS attempts FROM events) GROUP BY 1)"


@query(f"WITH {_LATEST} SELECT seq, synced, attempts AS sync_attempts FROM latest WHERE seq BETWEEN 20 AND 300", plain=True)
def sync_state_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.range(20, 301).select(F.col("id").alias("seq"))
    return sync.states_in_range(sync.compact_states(_states(spark, sf_dir)), entries).select("seq", "synced", F.col("sync_attempts").cast("long").alias("sync_attempts"))


@query(f"WITH {_LATEST} SELECT s.seq FROM (SELECT range AS seq FROM range(20, 301)) s LEFT JOIN latest l USING (seq) WHERE NOT coalesce(l.synced, false) AND coalesce(l.attempts, 0) < 3", plain=True)
def buffer_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.range(20, 301).select(F.col("id").alias("seq"))
    return sync.to_retry(entries, sync.compact_states(_states(spark, sf_dir))).select("seq")


@query("""SELECT segment, coalesce(day < TIMESTAMP '2024-02-01' - INTERVAL 72 HOUR AND segment <> max(segment) OVER (), false) AS expired
FROM (SELECT strftime(date_trunc('day', ts), 'segment_%Y%m%d_000000.jsonl') AS segment, date_trunc('day', ts) AS day FROM events GROUP BY 1, 2)""", plain=True)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "events").select(F.concat(F.lit("segment_"), F.date_format("ts", "yyyyMMdd"), F.lit("_000000.jsonl")).alias("segment")).distinct()
    return sync.retention_plan(segments, F.to_timestamp(F.lit("2024-02-01 00:00:00")))


# Events as they are sent


@query("""SELECT event_id, '{"event_type":"' || event_type || '","idempotency_key":"k' || event_id || '","payload":{"user":' || user_id || '},"severity":"info"' || CASE WHEN event_id % 2 = 0 THEN ',"source":"web"' ELSE '' END || ',"timestamp":"t"}' AS body FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 11 = 0""", plain=True)
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all events; a float in every eleventh payload is rejected."""
    ship(spark)
    n = F.col("event_id")
    value = F.when(n % 11 == 0, F.lit("1.5")).otherwise(F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit('{"user":'), value, F.lit("}")).alias("payload"), F.lit("info").alias("severity"), F.lit("t").alias("timestamp"), F.concat(F.lit("k"), n.cast("string")).alias("idempotency_key"), F.when(n % 2 == 0, "web").alias("source"))
    return events.request_bodies(rows).select("event_id", F.col("body.json").alias("body"))


@query("SELECT event_id, event_id % 10 <> 0 AS ok FROM ledger")
def payload_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads signed and verified; every tenth one is changed between."""
    ship(spark)
    rows = ledger_view(spark, sf_dir).select("event_id", "payload").withColumn("s", events.sign_payloads(F.col("payload"), SEED))
    sent = F.when(F.col("event_id") % 10 == 0, F.lit('{"other":1}')).otherwise(F.col("payload"))
    return rows.select("event_id", events.payload_signature_ok(sent, F.col("s.signature"), F.lit(ed25519.public_key(SEED).hex())).alias("ok"))


@query("""SELECT event_id FROM events WHERE event_type <> 'click' OR ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::INTEGER % 100 < 10""", plain=True)
def sampled_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sample_level(table(spark, sf_dir, "events"), "event_id", "event_type", "click", 10).select("event_id")


@query("""SELECT 'receipt' AS kind, event_id FROM ledger WHERE event_id % 5 IN (0, 1) UNION ALL SELECT 'dead', event_id FROM ledger WHERE event_id % 5 = 2 UNION ALL SELECT 'left', event_id FROM ledger WHERE event_id % 5 IN (3, 4)""")
def sync_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of the sender: 200; 503 then 200; 422; always 429; an unknown code."""
    rounds = [0]

    def send(rows: DataFrame) -> DataFrame:
        rounds[0] += 1
        codes = (200, 503 if rounds[0] == 1 else 200, 422, 429, 418)
        code = F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % 5 + 1).cast("int"))
        return rows.select("event_id", code.alias("code"), F.lit("r").alias("receipt"), F.lit("rejected").alias("reason"))

    done, dead, left = sync.sync_batch(ledger_view(spark, sf_dir).select("event_id"), send, F.lit("t"))
    out = done.select(F.lit("receipt").alias("kind"), "event_id").unionByName(dead.select(F.lit("dead").alias("kind"), "event_id"))
    return out.unionByName(left.select(F.lit("left").alias("kind"), "event_id"))


# BLAKE3 and Ed25519, which SQL does not have: vectors in tests hold these


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed records of all events, chained per stream."""
    rows = ledger_view(spark, sf_dir).select("stream_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), E.ns_to_rfc3339(F.col("timestamp_ns")).alias("ts_client"), "timestamp_ns", "payload")
    return append.append(rows, SEED, "root")


def _as_ledger(records: DataFrame) -> DataFrame:
    return records.select("stream_id", "event_id", F.col("stream_id").alias("segment"), F.col("seq").alias("line_no"), F.col("seq").alias("sequence"), "timestamp_ns", F.col("ts_client").alias("ts_client_raw"), "prev_hash", "payload", "payload_hash", "hash_alg", F.col("sig_client").alias("signature"), "public_key", "key_id", F.lit(None).cast("string").alias("parse_error"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("source"))


@query()
def entry_hash_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ledger_view(spark, sf_dir).select("event_id", entry_hash("sequence", "timestamp_ns", "prev_hash", "payload_hash").alias("entry_hash"), blake3_hex("payload").alias("payload_blake3"))


@query()
def append_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("stream_id", "seq", "event_id", "entry_hash", "sig_client")


@query()
def chain_root_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = ledger_view(spark, sf_dir).select(*ORDER, entry_hash("sequence", "timestamp_ns", "prev_hash", "payload_hash").alias("h"))
    return spark.createDataFrame([(chain_root(rows, list(ORDER), "h"),)], "chain_root string")


@query("SELECT event_id, event_id % 10 <> 0 AS ok FROM ledger")
def verify_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_view(spark, sf_dir).select("event_id", "entry_hash").withColumn("s", signer(SEED)("entry_hash"))
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.when(F.left("s", F.lit(1)) == "0", "1").otherwise("0"), F.substr("s", F.lit(2)))).otherwise(F.col("s"))
    ok = signature_ok(F.lit(ed25519.public_key(SEED).hex()), "entry_hash", broken)
    return rows.select("event_id", ok.alias("ok"))


@query("SELECT stream_id, true AS valid, 'valid' AS status, count(*) AS count, 1::BIGINT AS first_seq, count(*) AS last_seq, false AS is_authoritative, 0::BIGINT AS n_errors, 'resilient' AS mode FROM ledger GROUP BY 1")
def verify_chain_sdk(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written(spark, _as_ledger(_chain(spark, sf_dir)), "records").withColumn("receipt", F.lit(None).cast(RECEIPT))
    return verify.verify_wal(records, key_table(spark, {"root": ed25519.public_key(SEED)}))


@query()
def attestation_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime, timezone

    records = written(spark, _as_ledger(_chain(spark, sf_dir)), "records")
    return attest.attest_streams(records, SEED, "root", "0000", "9999", datetime(2025, 1, 1, tzinfo=timezone.utc)).drop("body")


@query("SELECT stream_id, event_id, sequence, timestamp_ns, prev_hash, payload_hash, event_type, source, signature FROM ledger")
def segments_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as segments, rolled by size, and read back by the line reader."""
    folder = scratch_path(spark, "segments")
    rows = ledger_view(spark, sf_dir).select("stream_id", F.col("event_id").cast("string").alias("event_id"), "sequence", "timestamp_ns", "prev_hash", "payload_hash", "event_type", "source", "signature")
    append.write_segments(rows.select("stream_id", "sequence", F.to_json(F.struct(*rows.columns)).alias("value")), folder, bytes_per_file=1 << 20)
    read = read_ledger(spark, folder).filter("parse_error IS NULL")
    return read.select("stream_id", F.col("event_id").cast("long").alias("event_id"), "sequence", "timestamp_ns", "prev_hash", "payload_hash", "event_type", "source", "signature")


@query("SELECT count(*) AS n_lines, count(DISTINCT stream_id) AS n_streams FROM ledger")
def segment_lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of written segments: in every segment they are numbered from 1 to their count."""
    folder = scratch_path(spark, "segments")
    rows = ledger_view(spark, sf_dir).select("stream_id", "sequence", F.to_json(F.struct("stream_id", "sequence")).alias("value"))
    append.write_segments(rows, folder, bytes_per_file=1 << 18)
    lines = read_lines(spark, folder)
    per = lines.groupBy("segment").agg(F.count("*").alias("n"), F.countDistinct("line_no").alias("distinct"), F.max("line_no").alias("last")).filter("n = distinct AND n = last")
    streams = lines.select(F.countDistinct(F.get_json_object("line", "$.stream_id")).alias("n_streams"))
    return per.agg(F.sum("n").alias("n_lines")).crossJoin(streams)  # one row each


@query("SELECT stream_id, true AS valid, 'valid' AS status, count(*) AS count, 1::BIGINT AS first_seq, count(*) AS last_seq, false AS is_authoritative, 0::BIGINT AS n_errors, 'resilient' AS mode, 0::BIGINT AS key_rotations, 'root' AS trusted_keys FROM ledger GROUP BY 1")
def verify_chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify_wal_with_root over the signed chain of all events: one row per stream, with rotations and trusted keys."""
    records = written(spark, _as_ledger(_chain(spark, sf_dir)), "records").withColumn("receipt", F.lit(None).cast(RECEIPT))
    return verify.verify_wal_with_root(records, "root", ed25519.public_key(SEED)).withColumn("trusted_keys", F.array_join("trusted_keys", ","))
