import re

import pytest
from pyspark.sql import functions as F

from wiregaze.config import Config
from wiregaze.functions import constants as C
from wiregaze.functions import scalars as S
from wiregaze.operators import intervals


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "text",
    ["user=bob@example.com&password=hunter2", "card 4111 1111 1111 1111 ok", "api_key: abc123 token=zzz", "Authorization: Bearer x\nnext", "AB123456C", "nothing here"],
)
def test_redaction_equals_python(spark, text):
    want = text
    for pattern, mark in C.REDACTIONS:
        want = re.sub(pattern, mark.replace("$1", r"\1"), want)
    assert one(spark, text, S.redact) == want


def test_redaction_hides_both_secrets(spark):
    got = one(spark, "user=bob@example.com&password=hunter2", S.redact)
    assert "bob" not in got and "hunter2" not in got


def test_excerpt_clips_then_redacts(spark):
    got = one(spark, bytearray(b"\x00\xffpassword=hunter2 " + b"a" * 80), S.payload_excerpt, "binary")
    assert got.startswith("..password=[REDACTED]") and "hunter2" not in got


@pytest.mark.parametrize("message, kind", [("DDoS DETECTED!", "ddos"), ("PORT SCAN DETECTED!", "scan"), ("MALICIOUS PAYLOAD! Keywords: ['MASSCAN']", "scan"), ("MALICIOUS PAYLOAD! ['UNION']", "sqli"), ("BLACKLISTED IP", "blacklist"), ("ANOMALY DETECTED", "anomaly"), ("hello", "unknown"), (None, "unknown")])
def test_kinds(spark, message, kind):
    assert one(spark, message, S.classify_kind) == kind


def test_addresses_and_flags(spark):
    assert one(spark, "10.1.2.3", S.anonymise_ip) == "10.1.2.0" and one(spark, "fe80::1", S.anonymise_ip) == "fe80::1"
    assert one(spark, 0x12, S.tcp_flags, "int") == "SYN, ACK" and one(spark, 0, S.tcp_flags, "int") == "-"


def test_dominant_source(spark):
    rows = [(0, "a", 80, 1), (0, "b", 20, 2), (1, "a", 40, 1), (1, "b", 35, 2), (1, "c", 25, 3), (2, "a", 5, 9), (2, "b", 5, 3)]
    df = spark.createDataFrame(rows, "second int, src string, packets int, first_seq int")
    assert {r["second"]: r["src"] for r in intervals.dominant_source(df).collect()} == {0: "a", 1: None, 2: "b"}


def test_config_layers(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"knn_k": "7", "zscore_threshold": "bad", "unknown": 1}')
    c = Config.load(str(p), {"WIREGAZE_BLOCK_ENABLED": "yes", "WIREGAZE_BLOCK_ON": "scan, ddos"}, knn_k=5)
    assert (c.knn_k, c.zscore_threshold, c.block_enabled, c.block_on) == (5, 3.0, True, ("scan", "ddos"))
