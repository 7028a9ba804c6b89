"""Golden values of the log format, and properties of the functions."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import blake3, ed25519
from ledgerloom.functions import expressions as E
from ledgerloom.functions.canonical import CanonicalError, canonical_json, has_colliding_keys
from ledgerloom.functions.hashing import entry_hash, entry_preimage, payload_hash

GENESIS = "0" * 64


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ({"z": 1, "a": 2, "m": 3}, '{"a":2,"m":3,"z":1}'),
        ({"key": "value", "nested": {"inner": 123}}, '{"key":"value","nested":{"inner":123}}'),
        ({"name": "café"}, '{"name":"café"}'),
        ({"café": "value"}, '{"café":"value"}'),
        ({"emoji": "👋🌍"}, '{"emoji":"👋🌍"}'),
        ([None, True, False, [], {}], "[null,true,false,[],{}]"),
        ({"q": 'a"b\\c\n'}, '{"q":"a\\"b\\\\c\\n"}'),
    ],
)
def test_canonical(value, expected):
    assert canonical_json(value).decode() == expected


def test_canonical_rejects_floats_and_node_takes_whole_ones():
    with pytest.raises(CanonicalError):
        canonical_json({"x": 1.0})
    assert canonical_json({"x": 1.0}, "node") == b'{"x":1}'
    with pytest.raises(CanonicalError):
        canonical_json({"x": 1.5}, "node")
    assert has_colliding_keys({"é": 1, "é": 2}) and not has_colliding_keys({"é": 1})
    assert canonical_json({"": 1, "😀": 2}).decode().startswith('{""')
    assert canonical_json({"": 1, "😀": 2}, "node").decode().startswith('{"😀"')


def test_blake3_vectors():
    assert blake3.hexdigest(b'{"event":"test"}') == "ba0ec9bd9cf1b301fae5608349497d6ac27dd1ea071ed9469b8894ba58f385b8"
    assert blake3.hexdigest(b"{}") == "6e46dd10defc9b56c29a6ec56b508c21f54c08192194e4df25bf36f0c9c3c279"
    assert blake3.hexdigest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.hexdigest(bytes(i % 251 for i in range(5120))).startswith("9cadc15fed8b5d85")


def test_blake3_lanes_agree_with_single_messages():
    sizes = [0, 1, 63, 64, 65, 144, 1023, 1024, 1025, 2048, 2049, 5000, 17500]
    messages = [bytes(i % 251 for i in range(n)) for n in sizes]
    assert blake3.digest_many(messages) == [blake3.digest_many([m])[0] for m in messages]


def test_entry_hash_vectors():
    first = blake3.hexdigest(entry_preimage(1, 1737720000000000000, GENESIS, "ba0ec9bd9cf1b301fae5608349497d6ac27dd1ea071ed9469b8894ba58f385b8"))
    assert first == "77adfc6abdc08c5e9e8f1da10b12f96f11a2609659e8bc5ea9d3854dd99c05db"


VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize(("seed", "public", "message", "signature"), VECTORS)
def test_ed25519(seed, public, message, signature):
    seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
    assert ed25519.public_key(seed) == public
    assert ed25519.sign(seed, message) == signature == ed25519._sign_slow(seed, message)
    for check in (ed25519.verify, ed25519._verify_slow):
        assert check(public, message, signature)
        assert not check(public, message + b"x", signature)
    assert not ed25519.verify(public[:-1], message, signature)
    assert not ed25519.verify(public, message, signature[:-1])


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8))
def test_canonical_is_stable(value):
    try:
        once = canonical_json(value)
    except CanonicalError:
        return
    assert canonical_json(json.loads(once)) == once


def test_timestamps(spark):
    cases = [
        ("2025-01-24T12:00:00Z", 1737720000000000000), ("2025-01-24T12:00:00+00:00", 1737720000000000000), ("2025-01-24T13:00:00+01:00", 1737720000000000000),
        ("2025-01-24T12:00:00.123456Z", 1737720000123456000), ("2025-01-24T12:00:00.123456789Z", 1737720000123456789), ("2025-01-24T12:00:00", 1737720000000000000),
        ("1969-12-31T23:59:59.5Z", -500000000), ("2025", None), ("12:00:00", None), (" 2025-01-24T12:00:00Z", None), ("3000-01-01T00:00:00Z", None), ("2025-13-01T00:00:00Z", None), (None, None), ("", None),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, want long")
    got = rows.select("want", E.iso_to_ns(F.col("t")).alias("ns"), E.iso_to_ns(F.col("t"), 3).alias("ms")).orderBy("k").collect()
    assert [r["ns"] for r in got] == [r["want"] for r in got]
    assert got[4]["ms"] == 1737720000123000000
    back = spark.createDataFrame([(0,), (1737720000123456789,), (-500000000,), (1737720000000001000,), (None,)], "ns long").select(E.ns_to_rfc3339(F.col("ns")).alias("t")).collect()
    assert [r["t"] for r in back] == ["1970-01-01T00:00:00+00:00", "2025-01-24T12:00:00.123456789+00:00", "1969-12-31T23:59:59.500+00:00", "2025-01-24T12:00:00.000001+00:00", None]


def test_hashing_udfs_pass_nulls_and_report_errors(spark):
    rows = spark.createDataFrame([(1, 1, GENESIS, "p1"), (None, 1, GENESIS, "p1")], "s long, t long, a string, b string")
    got = [r[0] for r in rows.select(entry_hash("s", "t", "a", "b")).collect()]
    assert got == [blake3.hexdigest(entry_preimage(1, 1, GENESIS, "p1")), None]
    rows = spark.createDataFrame([('{"event":"test"}', "blake3"), ("{}", "md5"), ('{"a":1.0}', "blake3"), ("{", "blake3"), (None, "blake3")], "p string, a string")
    got = [r[0] for r in rows.select(payload_hash(F.col("p"), F.col("a"))).collect()]
    assert got[0]["hash"].startswith("ba0ec9bd") and got[1]["hash"].startswith("44136fa355b3678a")
    assert got[2]["error"] and got[3]["error"] and got[4]["hash"] is None and got[4]["error"] is None


def test_small_expressions(spark):
    r = spark.range(1).select(
        E.stream_id(F.lit("k"), F.lit("")).alias("s"), E.shortened(F.lit("123456789")).alias("c"), E.shortened(F.lit("12345678")).alias("d"),
        E.syslog_severity(F.lit("EMERG")).alias("e"), E.windows_severity(F.lit("Error")).alias("w"), E.log_level_severity(F.lit("CRITICAL")).alias("l"), E.severity_rank(F.lit("high")).alias("r"), E.severity_rank(F.lit("x")).alias("x"),
        E.idempotency_key(F.lit(""), F.lit("a"), F.lit("b")).alias("i"), E.receipt_message(F.lit("e"), F.lit("p"), F.lit("t"), F.lit(3)).alias("m"), E.event_id().alias("v"),
    ).first()
    assert r["s"].startswith("stream_") and len(r["s"]) == 23
    assert (r["c"], r["d"], r["e"], r["w"], r["l"], r["r"], r["x"], r["m"]) == ("12345678…", "12345678", "critical", "high", "critical", 3, None, "e|p|t|3")
    assert r["i"].startswith("req:") and len(r["i"]) == 20 and r["v"].startswith("evt_")
    assert E.normal_root(" 0xAB ") == "ab"
