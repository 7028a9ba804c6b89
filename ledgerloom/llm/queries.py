"""The queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, decontam, langid, line_dedup, piece_scan, probminhash, quality, secrets, token_binary, warc
from ledgerloom.runtime import table, written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(fixture)
    return chat.digest(written(spark, chat.format_conversations(rows), "chat"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(archives).filter("gap_reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.classify(docs.select("doc_id", "text"), model, drop_text=True).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_binary.write_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_binary.read_tokens(spark, store)


def op5_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_scan.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    decoded = piece_scan.decode_documents(encoded, _tokenizer("piece_bpe_32k.model"))
    return decoded.select("doc_id", F.expr("length(packed) div 4").cast("long").alias("n_tokens"), F.crc32("packed").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.group_documents(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size")


def op10_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_prefix_targets, op2_warc_salvage, op3_language_bitmask, op4_token_files, op5_piece_scan, op6_compression_bands, op7_qgram_lemma, op8_line_minhash, op9_probminhash, op10_secret_randomness)
}



def _escaped(column: str) -> str:
    """SQL of chat.escape."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL: dict[str, str] = {
    "op1_chat_prefix_targets": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat.TURN + chat.SEP + chat.END)} + length({_escaped('role')}) + length({_escaped('text')})) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id""",
    "op2_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
digits AS (SELECT page_id, body, best, unnest(range(8)) AS i, sha1(body) AS hex FROM p),
parts AS (SELECT page_id, body, best, i, ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::INTEGER AS v FROM digits),
texts AS (SELECT page_id, body, best, string_agg(
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1), '' ORDER BY i) AS digest FROM parts GROUP BY 1, 2, 3)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM texts""",
}
