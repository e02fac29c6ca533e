"""Labelled CSV and JSON inputs, threat feeds, telemetry; all values are read as strings and checked in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise_label, strip


class DatasetError(ValueError):
    """A required column is missing."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings, headers trimmed and lower-cased, with row_no where one file keeps its order."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.strip().lower() for c in df.columns]).withColumn("row_no", F.monotonically_increasing_id())


def require(df: DataFrame, path: str, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DatasetError(f"{path}: missing column {', '.join(missing)}")


def number(name: str, path: str) -> Column:
    """The column as double; a bad value fails the query with its row."""
    v = F.expr(f"try_cast(btrim(`{name}`, ' \t\n\r') as double)")
    where = F.concat(F.lit(f"{path}: bad {name} in row "), (F.col("row_no") + 2).cast("string"))
    return F.when(v.isNull() | F.isnan(v), F.raise_error(where).cast("double")).otherwise(v)


def load_knn_csv(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    require(df, path, "unique_ports", "packet_count", "label")
    return df.select("row_no", number("unique_ports", path).cast("long").alias("unique_ports"), number("packet_count", path).cast("long").alias("packet_count"), normalise_label(F.col("label")).alias("label"))


def load_payload_csv(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    require(df, path, "payload", "label")
    return df.select("row_no", F.coalesce("payload", F.lit("")).alias("payload"), normalise_label(F.col("label")).alias("label"))


def load_kmeans_csv(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    ports = "unique_ports" if "unique_ports" in df.columns else "ports"
    require(df, path, "pps", ports)
    label = normalise_label(F.col("label")) if "label" in df.columns else F.lit("Normal")
    return df.select("row_no", number("pps", path).alias("pps"), number(ports, path).alias("unique_ports"), label.alias("label"))


def load_zscore_csv(spark: SparkSession, path: str, raw_labels: bool = False) -> DataFrame:
    df = read_csv(spark, path)
    require(df, path, "pps", "label")
    pps = number("pps", path)
    if not raw_labels:
        pps = F.when(pps < 0, F.raise_error(F.lit(f"{path}: negative pps")).cast("double")).otherwise(pps)
    return df.select("row_no", (pps.cast("long").cast("double") if raw_labels else pps).alias("pps"), (strip(F.col("label")) if raw_labels else normalise_label(F.col("label"))).alias("label"))


def load_bloom_csv(spark: SparkSession, path: str, raw_labels: bool = False) -> DataFrame:
    df = read_csv(spark, path)
    ip = "ip" if "ip" in df.columns else "src_ip"
    require(df, path, ip, "label")
    out = df.select("row_no", strip(F.col(ip)).alias("ip"), (strip(F.col("label")) if raw_labels else normalise_label(F.col("label"))).alias("label"))
    return out.where("ip is not null and ip <> ''")


#: Names of the packet count in flow files, in order of preference.
PACKET_COLUMNS = ("tot fwd pkts", "totfwdpkts", "tot sum", "packet_count", "packets")


def load_flows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flow file -> scan rows (unique_ports, packet_count, label) and cluster rows (pps, unique_ports); bad rows are left out."""
    df = read_csv(spark, path)
    label = "label" if "label" in df.columns else "attack"
    packets = next((c for c in PACKET_COLUMNS if c in df.columns), None)
    require(df, path, label, "unique_ports")
    if packets is None:
        raise DatasetError(f"{path}: no packet count")
    value = lambda c: F.expr(f"try_cast(btrim(`{c}`, ' \t\n\r') as double)")
    rows = df.select("row_no", value("unique_ports").alias("p"), value(packets).alias("n"), normalise_label(F.col(label)).alias("l"))
    rows = rows.where("p is not null and n is not null and not isnan(p) and not isnan(n)").select("row_no", F.col("p").cast("long").alias("p"), F.col("n").cast("long").alias("n"), "l")
    rows = rows.where("n >= 0 and p >= 0 and p <= n")
    label_ = F.when(F.col("l") == "Scan", "Scan").otherwise("Normal")
    return rows.select("row_no", F.col("p").alias("unique_ports"), F.col("n").alias("packet_count"), label_.alias("label")), rows.select("row_no", F.col("n").cast("double").alias("pps"), F.col("p").cast("double").alias("unique_ports"))


def load_rate_series(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = read_csv(spark, path)
    require(df, path, "rate", "label")
    rate = F.expr("try_cast(btrim(`rate`, ' \t\n\r') as double)")
    out = df.select("row_no", rate.alias("r"), F.when(F.upper(strip(F.col("label"))) == "BENIGN", "Normal").otherwise("DDoS").alias("label"))
    out = out.where("r is not null and not isnan(r) and abs(r) < double('infinity')").select("row_no", F.col("r").cast("long").alias("pps"), "label")
    return out.orderBy("row_no").limit(limit) if limit else out


TRAINING = "knn array<array<string>>, payload array<struct<payload:string,label:string>>, kmeans array<array<double>>"


def load_training_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    df = spark.read.json(path, schema=TRAINING, multiLine=True)
    knn = df.select(F.posexplode("knn").alias("row_no", "r")).select("row_no", F.col("r")[0].cast("double").cast("long").alias("unique_ports"), F.col("r")[1].cast("double").cast("long").alias("packet_count"), normalise_label(F.col("r")[2]).alias("label"))
    payload = df.select(F.posexplode("payload").alias("row_no", "r")).select("row_no", "r.payload", normalise_label(F.col("r.label")).alias("label"))
    kmeans = df.select(F.posexplode("kmeans").alias("row_no", "r")).select("row_no", F.col("r")[0].alias("pps"), F.col("r")[1].alias("unique_ports"))
    return {"knn": knn, "payload": payload, "kmeans": kmeans}


def parse_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    item = strip(F.split(F.split(F.col(column), ",")[0], "#")[0])
    return lines.select(item.alias("indicator")).where("indicator <> ''")


def load_feed(spark: SparkSession, path: str) -> DataFrame:
    return parse_feed(spark.read.text(path))


TELEMETRY = "v int, ts string, message string, src_ip string, engine string, kind string, severity string, risk_score double, technique_id string, technique string, tactic string, confidence double, payload_excerpt string"


def parse_telemetry(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON with a message, else '[time] text', else an alert about the line itself."""
    j = F.from_json(F.col(column), TELEMETRY)
    legacy = F.col(column).rlike(r"^\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\]")
    is_json = j["message"].isNotNull()
    message = F.when(is_json, j["message"]).when(legacy, F.trim(F.regexp_replace(F.col(column), r"^\[[^\]]*\]\s*", ""))).otherwise(F.concat(F.lit("INVALID UDP PAYLOAD ("), F.substring(F.col(column), 1, 64), F.lit(")")))
    form = F.when(is_json, "json").when(legacy, "legacy").otherwise("invalid")
    ts = F.when(is_json, j["ts"]).when(legacy, F.regexp_extract(F.col(column), r"^\[([^\]]*)\]", 1))
    return lines.select(form.alias("form"), ts.alias("ts"), message.alias("message"), *[F.when(is_json, j[c]).alias(c) for c in ("src_ip", "engine", "kind", "severity", "risk_score", "technique_id", "technique", "tactic", "confidence")])


def telemetry_json(alerts: DataFrame, most: int = 1400) -> DataFrame:
    """alerts with the telemetry columns -> value: JSON of at most ``most`` bytes, the excerpt left out where it does not fit."""
    names = [n for n in (f.split()[0] for f in TELEMETRY.split(", ")) if n in alerts.columns]
    full = F.to_json(F.struct(*names))
    short = F.to_json(F.struct(*[n for n in names if n != "payload_excerpt"]))
    return alerts.select(F.when(F.octet_length(full) > most, short).otherwise(full).alias("value"))


def sample_flows(df: DataFrame, file: str, order: Column, total: int, files: int) -> DataFrame:
    """An even quota of rows from each file, the remainder to the first files by name, chosen by ``order``."""
    names = df.select(F.col(file).alias("f")).distinct().withColumn("k", F.row_number().over(Window.orderBy("f")))
    quota = F.lit(total // files) + (F.col("k") <= total % files).cast("int")
    # the planner keeps the first rows of each file before it moves them, as the quota has a bound
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy(order))).where(F.col("_n") <= total // files + 1)
    return rows.join(names.select(F.col("f").alias(file), quota.alias("_quota")), file).where("_n <= _quota").drop("_n", "_quota")
