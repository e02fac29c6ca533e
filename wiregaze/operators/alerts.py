"""Alert streams: dedup, policy, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parent_kind


def dedup(alerts: DataFrame, seconds: float = 5.0, ts: str = "t", keys: tuple[str, ...] = ("kind", "src", "message"), order: tuple[str, ...] = ()) -> DataFrame:
    """Adds published: a key's alert is held back until ``seconds`` after its last published one. One fold a key.

    ``order`` names the columns of the fold's order; by default ts, then seq where there is one.
    """
    order = order or ((ts, "seq") if "seq" in alerts.columns else (ts,))
    schema = f"{', '.join(f'`{n}` {k}' for n, k in alerts.dtypes)}, published boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        last, out = None, []
        for t in pdf[ts]:
            go = last is None or t - last >= seconds
            out.append(go)
            last = t if go else last
        return pdf.assign(published=out)

    return alerts.groupBy(*keys).applyInPandas(run, schema)


def block_decisions(alerts: DataFrame, block_on=("payload", "blacklist", "ddos", "scan"), whitelist=("127.0.0.1", "0.0.0.0"), enabled: bool = True) -> DataFrame:
    """The first alert of each source that policy would block. A table of decisions; nothing is carried out."""
    if not enabled:
        return alerts.limit(0)
    hits = alerts.where(F.col("src").isNotNull() & (F.col("kind").isin(*block_on) | parent_kind(F.col("kind")).isin(*block_on)) & ~F.col("src").isin(*whitelist))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("t", "seq"))).where("_n = 1").drop("_n")


def summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("kind").agg(F.count("*").alias("alerts"))


def stats(alerts: DataFrame, last: int = 100) -> DataFrame:
    """One row over the newest ``last`` alerts: conditional counts, highest risk."""
    recent = alerts.orderBy(F.desc("t"), F.desc("seq")).limit(last)
    count = lambda w: F.count_if(F.contains("message", F.lit(w)))
    return recent.agg(F.count("*").alias("total"), count("DDoS").alias("ddos"), count("SCAN").alias("scan"), count("PAYLOAD").alias("payload"), count("BLACKLIST").alias("blacklist"), F.max("risk_score").alias("max_risk"))


def suppressed(odd: DataFrame, *known: DataFrame, by: str) -> DataFrame:
    """The rows of ``odd`` whose interval none of the ``known`` detections has: those explain what is odd there."""
    for k in known:
        odd = odd.join(k.select(by).distinct(), by, "left_anti")
    return odd


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All engines' alerts as one table, duplicates kept."""
    for o in others:
        first = first.unionByName(o)
    return first


def sensors_online(heartbeats: DataFrame, now: float, seconds: float = 60.0) -> DataFrame:
    """sensor, t -> one row: the sensors last seen less than ``seconds`` before ``now``."""
    last = heartbeats.groupBy("sensor").agg(F.max("t").alias("t"))
    return last.agg(F.count_if(F.lit(now) - F.col("t") < seconds).alias("online_sensors"))


def top_techniques(alerts: DataFrame, last: int = 100, n: int = 5) -> DataFrame:
    recent = alerts.orderBy(F.desc("t"), F.desc("seq")).limit(last).where("technique_id <> 'N/A'")
    return recent.groupBy(F.concat_ws(" ", "technique_id", "technique").alias("technique")).agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "technique").limit(n)


def rising(verdicts: DataFrame, flag: str, by: str, order: str) -> DataFrame:
    """Rows where the flag is set and was not in the key's previous row."""
    w = Window.partitionBy(by).orderBy(order)
    return verdicts.withColumn("_was", F.coalesce(F.lag(flag).over(w), F.lit(False))).where(F.col(flag) & ~F.col("_was")).drop("_was")


def retain(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)
