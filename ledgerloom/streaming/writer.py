"""Structured Streaming: a chained, signed writer per stream, and idempotent intake."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.operators.append import SCHEMA, link_batch
from ledgerloom.runtime import ship

STATE = StructType([StructField("seq", LongType()), StructField("prev_hash", StringType())])


class ChainWriter(StatefulProcessor):
    """Keeps each stream's sequence and last hash in the state store; a micro-batch's rows are sorted, linked and signed."""

    def __init__(self, seed: bytes, key_id: str):
        self.seed, self.key_id = seed, key_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["timestamp_ns", "event_id"], kind="stable")
        states = {key[0]: tuple(self.state.get())} if self.state.exists() else {}
        out = pd.DataFrame(link_batch(part, states, self.seed, self.key_id))
        self.state.update(states[key[0]])
        yield out[[c.split()[0] for c in SCHEMA.split(", ")]]

    def close(self) -> None:
        pass


def append_stream(events: DataFrame, seed: bytes, key_id: str) -> DataFrame:
    """A streaming DataFrame of records. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    ship(events.sparkSession)
    rows = events.select("stream_id", "event_id", "ts_client", "timestamp_ns", "payload")
    return rows.groupBy("stream_id").transformWithStateInPandas(ChainWriter(seed, key_id), SCHEMA, "Append", "None")


def once_per_key(events: DataFrame, time: str = "ts", key: str = "idempotency_key", delay: str = "1 hour") -> DataFrame:
    """Drops repeats of an idempotency key that arrive within the delay; state older than that is forgotten."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
