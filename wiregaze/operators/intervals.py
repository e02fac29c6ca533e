"""Packets -> features per interval and per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running


def without_own_traffic(packets: DataFrame, ports: tuple[int, ...] = (8080, 9999)) -> DataFrame:
    return packets.where(~F.col("sport").isin(*ports) & ~F.col("dport").isin(*ports))


def assign_seconds(packets: DataFrame, ts: str = "ts_us", out: str = "second", in_order: bool = False) -> DataFrame:
    """Whole seconds since the first record. With in_order a late record joins the newest second before it.

    The origin is one aggregate row, joined by broadcast: its size is fixed.
    """
    first = packets.agg(F.min_by(ts, "no").alias("_first")) if "no" in packets.columns else packets.agg(F.min(ts).alias("_first"))
    df = packets.crossJoin(F.broadcast(first)).withColumn(out, F.floor((F.col(ts) - F.col("_first")) / 1_000_000)).drop("_first")
    return running(df, "no", {out: F.col(out)}, "max") if in_order else df


def visible_port():
    """Ports count where the source is not listed and there is a port."""
    return F.when(~F.coalesce(F.col("bl_hit"), F.lit(False)) & (F.col("dport") != 0), F.col("dport"))


def per_interval(packets: DataFrame, by: str = "second") -> DataFrame:
    """pps and unique_ports of each interval; packets need ``by``, dport, bl_hit."""
    return packets.groupBy(by).agg(F.count("*").alias("pps"), F.count_distinct(visible_port()).alias("unique_ports"))


def per_source(packets: DataFrame, by: str = "second") -> DataFrame:
    return packets.groupBy(by, "src").agg(F.count("*").alias("packets"), F.count_distinct(visible_port()).alias("unique_ports"), F.min("seq_no").alias("first_seq"))


def dominant_source(sources: DataFrame, by: str = "second", min_share: float = 0.50) -> DataFrame:
    """The source with most packets (ties: first seen), null below the share."""
    share = min(1.0, max(0.0, min_share))
    top = sources.groupBy(by).agg(F.max_by("src", F.struct("packets", -F.col("first_seq"))).alias("s"), F.max("packets").alias("m"), F.sum("packets").alias("total"))
    return top.select(by, F.when(F.col("m") / F.col("total") >= share, F.col("s")).alias("src"), "total")


def fill_gaps(intervals: DataFrame, by: str = "second") -> DataFrame:
    """Empty intervals as rows of zero."""
    span = intervals.agg(F.min(by).alias("a"), F.max(by).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(by))
    return span.join(intervals, by, "left").na.fill(0)


def protocol_mix(packets: DataFrame) -> DataFrame:
    names = packets.sparkSession.createDataFrame([(n,) for n in ("TCP", "UDP", "ICMP", "OTHER")], "proto string")
    return names.join(packets.groupBy("proto").count(), "proto", "left").select("proto", F.coalesce("count", F.lit(0)).alias("packets"))


def top_talkers(packets: DataFrame, n: int = 5) -> DataFrame:
    return packets.groupBy("src").agg(F.count("*").alias("packets"), F.min("seq_no").alias("first_seq")).orderBy(F.desc("packets"), "first_seq").limit(n).select("src", "packets")


def recent(packets: DataFrame, limit: int = 200, proto: str | None = None, query: str | None = None, after: int = 0) -> DataFrame:
    """Newest first; proto is an equality (ALL: any), query a case-insensitive substring."""
    df = packets.where(F.col("no") > after)
    if proto and proto.upper() != "ALL":
        df = df.where(F.col("proto") == proto.upper())
    if query:
        q = F.lit(query.lower())
        df = df.where(F.contains(F.lower("src"), q) | F.contains(F.lower("dst"), q) | F.contains(F.lower("info"), q) | F.contains(F.lower("verdict"), q))
    return df.orderBy(F.desc("no")).limit(limit)


def traffic_snapshot(packets: DataFrame, by: str = "second", window: int = 30, capacity: int = 5000) -> DataFrame:
    """``store_snapshot`` and the newest interval's pps with the mean and z-score of up to ``window`` intervals before it, two digits each."""
    recent = per_interval(packets, by).select(by, "pps").orderBy(F.desc(by)).limit(window + 1)
    newest = F.max_by("pps", by)
    before = F.array_sort(F.collect_list(F.struct(F.col(by).alias("t"), F.col("pps").cast("double").alias("x"))))
    one = recent.agg(newest.alias("pps"), before.alias("_all"))
    h = F.transform(F.slice("_all", 1, F.size("_all") - 1), lambda r: r["x"])
    one = one.withColumn("_h", F.when(F.size("_all") > 2, h).otherwise(F.array().cast("array<double>")))
    add = lambda f: F.aggregate("_h", F.lit(0.0), lambda a, x: a + f(x)) / F.greatest(F.size("_h"), F.lit(1))
    one = one.withColumn("_m", add(lambda x: x))
    one = one.withColumn("_s", F.sqrt(add(lambda x: (x - F.col("_m")) * (x - F.col("_m")))))
    z = F.when(F.col("_s") > 0, (F.col("pps") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    # one row each
    return store_snapshot(packets, capacity).crossJoin(F.broadcast(one.select("pps", F.round("_m", 2).alias("mean"), F.round(z, 2).alias("z_score"))))


def store_snapshot(packets: DataFrame, capacity: int = 5000) -> DataFrame:
    return packets.agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(capacity)).alias("buffered"), F.lit(capacity).alias("capacity"), *[F.count_if(F.col("proto") == p).alias(p.lower()) for p in ("TCP", "UDP", "ICMP", "OTHER")])
