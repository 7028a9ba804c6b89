"""The chain root: BLAKE3 over all entry hashes' hex texts in order, as a parallel tree.

A BLAKE3 chunk of 1,024 bytes is exactly 16 hashes, and chunks hash independently of each other, so tasks hash chunks and then combine
1,024 neighbouring nodes at a time, level by level. No task sees more than its share and the driver gets one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import blake3
from ledgerloom.runtime import ship, written

PER_CHUNK, FAN = 16, 1024


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place from 0 in a global order, by counts per range partition."""
    spark = rows.sparkSession
    placed = written(spark, rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    base = counts.select("__part", (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"))  # a row per partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return placed.withColumn("__k", local).join(F.broadcast(base), "__part").withColumn("idx", (F.col("__base") + F.col("__k")).cast("long")).drop("__part", "__base", "__k")


def _combine(top: bool):
    """A function of a group's nodes: their one parent, with the root's flag at the top."""

    def run(key, nodes):
        values = nodes.sort_by("at")["value"].to_pylist()
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([blake3.reduce(values, top)], pa.binary())})

    return run


def chain_root(rows: DataFrame, order: list[str], column: str = "entry_hash") -> str:
    """The root in hex of rows in an order; no rows hash the empty text."""
    spark = rows.sparkSession
    ship(spark)
    hashes = numbered(rows.select(*order, column), order).select("idx", F.col(column).alias("h"))
    chunks = hashes.groupBy(F.expr(f"idx div {PER_CHUNK}").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]), "").alias("text"))
    chunks = written(spark, chunks, "root-chunks")
    n = chunks.count()
    if n <= 1:
        got = chunks.first()
        return blake3.hexdigest(got["text"].encode() if got else b"")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = blake3.chunks_at([t.encode() for t in text], at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["at", "value"])

    nodes = chunks.select("at", "text").mapInArrow(leaves, "at long, value binary")
    while True:
        top = n <= FAN

        nodes = written(spark, nodes.groupBy(F.expr(f"at div {FAN}").alias("up")).applyInArrow(_combine(top), "at long, value binary"), "root-level")
        if top:
            return bytes(nodes.first()["value"]).hex()
        n = -(-n // FAN)
