"""Audit CSV, HTML report, JSON export and model files."""

from __future__ import annotations

import html
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import anonymise_ip, enrich, payload_excerpt, report_kind

AUDIT_COLUMNS = ("Timestamp", "Source IP", "Engine", "Verdict", "Severity", "Risk Score", "Confidence", "ATT&CK Technique", "ATT&CK Tactic", "Payload Excerpt", "Message")


def audit_rows(alerts: DataFrame, config: Config = Config()) -> DataFrame:
    """alerts: ts, src, engine, message, confidence[, kind][, payload binary] -> the audit columns, privacy applied."""
    e = enrich(F.col("message"), F.col("confidence"))
    verdict = F.coalesce("kind", e["kind"]) if "kind" in alerts.columns else e["kind"]
    excerpt = payload_excerpt(F.col("payload"), config.payload_excerpt_bytes, config.privacy_mode) if "payload" in alerts.columns else F.lit(None).cast("string")
    values = (
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), anonymise_ip(F.coalesce("src", F.lit("N/A")), config.anonymise_ips), F.col("engine"), verdict, e["severity"], e["risk_score"],
        F.when(F.col("confidence").isNull(), "").otherwise(F.format_string("%.4f", "confidence")), e["technique_id"], e["tactic"], F.coalesce(excerpt, F.lit("")), F.col("message"),
    )
    return alerts.select(*[v.alias(n) for v, n in zip(values, AUDIT_COLUMNS)])


def write_audit(alerts: DataFrame, path: str, config: Config = Config()) -> None:
    """Append; a folder written with other columns is moved aside first."""
    spark = alerts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p) and tuple(spark.read.csv(path, header=True).columns) not in (AUDIT_COLUMNS, ()):
        fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}.legacy_{datetime.now():%Y%m%d_%H%M%S}"))
    audit_rows(alerts, config).write.mode("append").csv(path, header=True, quote='"', escape='"')


def write_report(alerts: DataFrame, path: str, limit: int = 1000) -> bool:
    """HTML report of the newest ``limit`` alerts; no file without alerts."""
    rows = alerts.select("ts", "src", "message", report_kind(F.col("message")).alias("kind")).orderBy(F.desc("ts")).limit(limit).collect()
    if not rows:
        return False
    counts = {r["kind"]: r["count"] for r in alerts.groupBy(report_kind(F.col("message")).alias("kind")).count().collect()}
    head = "".join(f"<li>{html.escape(k)}: {n}</li>" for k, n in sorted(counts.items()))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    Path(path).write_text(f"<!DOCTYPE html><meta charset=utf-8><title>Alerts</title><ul>{head}</ul><table>{body}</table>")
    return True


def write_brain(brain: dict, base: str) -> str:
    path = f"{base}_{datetime.now():%Y%m%d_%H%M%S}.json"
    Path(path).write_text(json.dumps(brain))
    return path


def latest_brain(base: str) -> dict | None:
    found = sorted(Path(base).parent.glob(Path(base).name + "_*.json"))
    return json.loads(found[-1].read_text()) if found else None


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a model table partitioned by ``version``."""
    df = spark.read.parquet(path)
    return df.join(df.agg(F.max("version").alias("version")), "version")
