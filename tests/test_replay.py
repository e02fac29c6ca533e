import pytest
from pyspark.sql import functions as F

from wiregaze.functions.frames import build_icmp, build_tcp, build_udp, decode
from wiregaze.plans.replay import engine_hits, replay, scenario
from wiregaze.sources.pcap import PcapDataSource, PcapError, read_pcap, records, write_pcap


@pytest.fixture(scope="module")
def alerts(spark):
    return replay(scenario(spark)).cache()


def test_scenario_has_its_frames(spark):
    assert scenario(spark).count() == 13159


def test_every_engine_fires_as_published(alerts):
    assert {r["engine"]: r["alerts"] for r in engine_hits(alerts).collect()} == {"knn": 1, "zscore": 1, "kmeans": 4, "naive_bayes": 4, "bloom": 5}


def test_nothing_before_the_scan(alerts):
    assert alerts.where("t < 15").count() == 0


def test_scan_alert(alerts):
    r = alerts.where("engine = 'knn'").first()
    assert (r["second"], r["src"], r["message"], r["risk_score"], r["confidence"]) == (15, "192.168.1.66", "PORT SCAN DETECTED! (Unique Ports: 200/sec)", 5.0, 1.0)


def test_flood_alert(alerts):
    r = alerts.where("engine = 'zscore'").first()
    assert (r["second"], r["src"], r["message"], r["risk_score"]) == (22, "192.168.1.99", "DDoS DETECTED! Z-Score: 17.53 (PPS: 1500)", 8.5)


def test_novelty_alerts(alerts):
    rows = alerts.where("engine = 'kmeans'").orderBy("t").collect()
    assert [(r["second"], r["src"]) for r in rows] == [(20, "192.168.1.99"), (21, "192.168.1.99"), (28, "192.168.1.77"), (29, "10.0.0.66")]
    assert [r["risk_score"] for r in rows] == [4.5, 4.5, 4.0, 4.0]


def test_payload_alerts(alerts):
    rows = alerts.where("engine = 'naive_bayes'").orderBy("t").collect()
    assert [r["kind"] for r in rows] == ["sqli", "xss", "lfi", "payload"]
    assert [r["t"] for r in rows] == [28.0, 28.25, 28.5, 28.75]
    assert rows[0]["message"] == "MALICIOUS PAYLOAD! Confidence: 99.93% Keywords: ['UNION', 'SELECT']"
    assert rows[3]["confidence"] == pytest.approx(0.999073, abs=1e-6)


def test_listed_source_alerts(alerts):
    rows = alerts.where("engine = 'bloom'").collect()
    assert len(rows) == 5 and all(r["message"] == "BLACKLISTED IP DETECTED: 10.0.0.66 (Flagged)" for r in rows)
    assert rows[0]["confidence"] == pytest.approx(0.999999784) and rows[0]["risk_score"] == 7.5


def test_decode_vlan_udp_icmp_and_damaged(spark):
    tcp = build_tcp(1000, 443, 0x12, b"hello")
    vlan = tcp[:12] + b"\x81\x00\x00\x05" + tcp[12:]
    rows = [tcp, vlan, build_udp(53, 5353, b"q"), build_icmp(8, 0, b"x"), tcp[:12] + b"\x86\xdd" + tcp[14:], tcp[:20], b"", None]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "i int, raw binary")
    got = {r["i"]: r for r in decode(df).collect()}
    assert [got[i]["status"] for i in range(8)] == ["ok", "ok", "ok", "ok", "non_ipv4", "malformed", "malformed", "malformed"]
    assert got[1]["dport"] == 443 and got[1]["payload"] == b"hello" and got[0]["flags"] == "SYN, ACK"
    assert (got[2]["proto"], got[2]["sport"], got[2]["payload"]) == ("UDP", 53, b"q")
    assert (got[3]["proto"], got[3]["icmp_type"], got[3]["dport"]) == ("ICMP", 8, 0)
    assert got[0]["src"] == "192.168.1.10"


def test_pcap_round_trip(spark, tmp_path):
    frames = scenario(spark).orderBy("no").limit(40)
    path = str(tmp_path / "a.pcap")
    assert write_pcap(frames, path, snaplen=32) == 40
    spark.dataSource.register(PcapDataSource)
    for df in (spark.read.format("pcap").load(path), read_pcap(spark, path)):
        rows = df.orderBy("no").collect()
        assert len(rows) == 40 and all(len(r["raw"]) == 32 and r["orig_len"] == 78 for r in rows)
        assert rows[0]["ts_us"] == 1_700_000_000_000_000


def test_pcap_both_orders_and_damage():
    import struct

    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 5, 7000, 3, 9) + b"abc"
    assert list(records(big + b"\0" * 10)) == [(5_000_007, b"abc", 3, 9)]
    with pytest.raises(PcapError):
        list(records(b"x" * 30))
    with pytest.raises(PcapError):
        list(records(b"\xd4\xc3"))


def test_replay_of_no_frames(spark):
    assert replay(scenario(spark).where(F.lit(False))).count() == 0
