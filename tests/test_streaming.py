"""The streaming writer keeps one chain per stream over micro-batches and restarts."""

import json

from ledgerloom.functions.expressions import GENESIS
from ledgerloom.streaming.writer import append_stream, once_per_key

SCHEMA = "stream_id string, event_id string, ts_client string, timestamp_ns long, payload string"


def run(spark, src, out, check):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    q = append_stream(events, bytes(range(32)), "k").writeStream.format("parquet").option("checkpointLocation", str(check)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)


def test_chain_goes_on_over_batches_and_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda k: json.dumps({"stream_id": f"s{k % 2}", "event_id": f"e{k}", "ts_client": "t", "timestamp_ns": k, "payload": "{}"})
    (src / "a.json").write_text("\n".join(line(k) for k in range(6)))
    run(spark, src, tmp_path / "out", tmp_path / "check")
    (src / "b.json").write_text("\n".join(line(k) for k in range(6, 10)))
    run(spark, src, tmp_path / "out", tmp_path / "check")
    for s in ("s0", "s1"):
        rows = spark.read.parquet(str(tmp_path / "out")).filter(f"stream_id = '{s}'").orderBy("seq").collect()
        assert [r["seq"] for r in rows] == [1, 2, 3, 4, 5]
        assert [r["prev_hash"] for r in rows] == [GENESIS, *(r["entry_hash"] for r in rows[:-1])]


def test_repeats_of_a_key_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"ts": "2024-01-01T00:00:00Z", "idempotency_key": k}) for k in "aabab"))
    events = spark.readStream.schema("ts timestamp, idempotency_key string").json(str(src))
    q = once_per_key(events).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2
