"""The corpus pipeline: five stages over documents, each written and read again before the next.

A stage takes what the one before has written; so the tables that its result was read from are deleted when the next one begins.

Defined results: documents with null or letterless text go at the first stage; null ids stay null; repeated rows and repeated ids are
documents like others until the near-duplicate stage keeps one of equal ones; an empty table gives no rows, an empty benchmark drops
nothing; columns other than those of documents are left out. Long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, line_dedup, piece_scan, probminhash
from ledgerloom.runtime import delete_path, scratch_path, sweep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language explains too few of their n-grams."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    judged = langid.classify(docs.select(*COLUMNS), model)
    return judged.filter(f"lang_pred <> 'und' AND coverage >= {langid.MIN_COVERAGE}").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each near-equal line; documents that lose all their lines go."""
    sweep(spark)
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), drop_emptied=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    sweep(spark)
    return probminhash.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    sweep(spark)
    return decontam.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and tokens (little-endian uint32 ids, end to end) of each document."""
    import public_tokenizers

    sweep(spark)
    encoded = piece_scan.encode_documents(docs, model or public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.expr("length(packed) div 4").cast("long").alias("n_tokens"), F.col("packed").alias("tokens"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("pieces", pieces),
]

#: SQL can't express the stages (n-gram filters, shingle signatures, alignment, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
