"""Structured Streaming: interval features with a watermark, stateful detectors, alert dedup, fan-out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import visible_port
from ..operators.kmeans import Novelty
from ..operators.zscore import Guarded


def interval_features(packets: DataFrame, ts: str = "ts", width: str = "1 second", late: str = "10 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """pps and unique_ports per tumbling window. Exact distinct counts are sets here, as streams have no count_distinct."""
    return (
        packets.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
        .agg(F.count("*").alias("pps"), F.size(F.collect_set(visible_port())).alias("unique_ports"))
        .select(F.col("window.start").alias("start"), *by, "pps", "unique_ports")
    )


Z_OUT = "series string, t long, pps double, z double, candidate boolean, streak long, is_threat boolean, new_threat boolean, confidence double"


def guarded_zscore(intervals: DataFrame, series: str = "series", t: str = "t", value: str = "pps", start: dict | None = None, **settings) -> DataFrame:
    """The guarded fold with its history in the state store; rows of a micro-batch are taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Guarded(**settings)
        if state.exists:
            fold.restore(json.loads(state.get[0]))
        elif start:
            fold.restore(start)
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        out = []
        for at, x in zip(rows[t], rows[value]):
            _, _, z, _, cand, streak, threat, new, conf, _ = fold.step(float(x))
            out.append((key[0], int(at), float(x), z, cand, streak, threat, new, conf))
        state.update((fold.to_json(),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in Z_OUT.split(", ")])

    return intervals.select(F.col(series).cast("string").alias(series), F.col(t).cast("long").alias(t), F.col(value).cast("double").alias(value)).groupBy(series).applyInPandasWithState(run, Z_OUT, "state string", "append", GroupStateTimeout.NoTimeout)


K_OUT = "series string, t long, cluster long, distance double, threshold double, is_threat boolean, confidence double"


def novelty(intervals: DataFrame, series: str = "series", t: str = "t", start: dict | None = None) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Novelty.from_dict(json.loads(state.get[0])) if state.exists else Novelty.from_dict(start) if start else Novelty()
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        out = []
        for at, a, b in zip(rows[t], rows["pps"], rows["unique_ports"]):
            k, d, _, limit, threat, conf, *_ = fold.step(float(a), float(b))
            out.append((key[0], int(at), k, d, limit, threat, conf))
        state.update((json.dumps(fold.to_dict()),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in K_OUT.split(", ")])

    df = intervals.select(F.col(series).cast("string").alias(series), F.col(t).cast("long").alias(t), F.col("pps").cast("double").alias("pps"), F.col("unique_ports").cast("double").alias("unique_ports"))
    return df.groupBy(series).applyInPandasWithState(run, K_OUT, "state string", "append", GroupStateTimeout.NoTimeout)


D_OUT = "kind string, src string, message string, t double"


def dedup(alerts: DataFrame, seconds: float = 5.0, forget_ms: int | None = None) -> DataFrame:
    """Published alerts only; state is the time of a key's last published one.

    forget_ms drops the state of keys quiet for so long; such a stream never ends by itself, as timers stay due.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(x for b in batches for x in b["t"]):
            if last is None or at - last >= seconds:
                out.append((*key, at))
                last = at
        state.update((last,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["kind", "src", "message", "t"])

    return alerts.select("kind", "src", "message", F.col("t").cast("double").alias("t")).groupBy("kind", "src", "message").applyInPandasWithState(run, D_OUT, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def limited(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the files of a folder that takes at most ``files`` a micro-batch: what does not fit waits, nothing is dropped."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def publish(stream: DataFrame, name: str, every: str | None = "1 second", mode: str = "append"):
    """Keep a stream's rows as a table of the session, which pages poll by queries; None for ``every`` ends with the input."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**trigger).start()


def to_console(stream: DataFrame, every: str = "1 second", mode: str = "append"):
    """Print a stream's rows."""
    return stream.writeStream.format("console").option("truncate", False).outputMode(mode).trigger(processingTime=every).start()


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, trigger: dict | None = None):
    """Each micro-batch to every sink; the batch is computed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
