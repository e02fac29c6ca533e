"""Rolling z-score: naive as a window, guarded as a fold per series."""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import rank, running, with_context

WARM = 5


def naive(df: DataFrame, order: str, value: str, by: list[str] | None = None, window: int = 30, threshold: float = 3.0, min_pps: float = 500.0, persist: int = 3) -> DataFrame:
    """Each row against up to ``window`` rows before it, all admitted. Adds mean, std, z, candidate, streak, is_threat, new_threat."""
    block = own = None
    if not by:  # one series: blocks, each led by the rows its first windows need
        df, block, own = with_context(rank(df, order, "_place"), "_place", window)
    w = Window.partitionBy(*by or [block]).orderBy(order)
    frame = w.rowsBetween(-window, -1)
    n = F.count(value).over(frame)
    df = df.withColumn("_n", n).withColumn("mean", F.when(F.col("_n") < 2, 0.0).otherwise(F.avg(value).over(frame))).withColumn("std", F.when(F.col("_n") < 2, 0.0).otherwise(F.stddev_pop(value).over(frame)))
    z = F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    df = df.withColumn("z", z)
    df = df.withColumn("candidate", (F.col("_n") >= WARM) & (F.col("std") > 0) & (F.col("z") > threshold) & (F.col(value) >= min_pps))
    if own:
        df = running(df.where(own).drop(block, own), "_place", {"_last": F.when(~F.col("candidate"), F.col("_place"))}, "max")
        df = df.withColumn("streak", F.when(F.col("candidate"), F.col("_place") - F.coalesce("_last", F.lit(-1))).otherwise(0))
        return df.withColumn("is_threat", F.col("candidate") & (F.col("streak") >= persist)).withColumn("new_threat", F.col("candidate") & (F.col("streak") == persist)).drop("_n", "_place", "_last")
    # rows since the last one that is no candidate
    group = F.sum((~F.col("candidate")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_g", group)
    df = df.withColumn("streak", F.sum(F.col("candidate").cast("long")).over(Window.partitionBy(*by or [], "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("is_threat", F.col("candidate") & (F.col("streak") >= persist)).withColumn("new_threat", F.col("candidate") & (F.col("streak") == persist))
    return df.drop("_n", "_g")


class Guarded:
    """State of one series: history of admitted values, session moments, streak."""

    def __init__(self, window: int = 30, threshold: float = 3.0, min_pps: float = 500.0, persist: int = 3, guard: bool = True):
        self.window, self.threshold, self.min_pps, self.persist, self.guard = window, threshold, min_pps, persist, guard
        self.history: deque[float] = deque(maxlen=window)
        self.streak, self.count, self.mean, self.m2, self.peak = 0, 0, 0.0, 0.0, 0.0

    def baseline(self) -> tuple[float, float]:
        n = len(self.history)
        if n < 2:
            return 0.0, 0.0
        # Welford's steps in the order of admission, as in SQL: a z on the threshold is decided by the last digit
        mean = m2 = 0.0
        for i, x in enumerate(self.history, 1):
            d = x - mean
            mean += d / i
            m2 += d * (x - mean)
        return math.fsum(self.history) / n, math.sqrt(m2 / n)

    def z_of(self, x: float) -> float:
        """z of a value against the present baseline, which it does not change."""
        mean, std = self.baseline()
        return (x - mean) / std if std > 0 else 0.0

    def step(self, x: float, update: bool = True) -> tuple:
        """mean, std, z, stat anomaly, candidate, streak, is_threat, new_threat, confidence, baseline size after."""
        mean, std = self.baseline()
        z = (x - mean) / std if std > 0 else 0.0
        odd = len(self.history) >= WARM and std > 0 and z > self.threshold
        candidate = odd and x >= self.min_pps
        self.streak = self.streak + 1 if candidate else 0
        if update:
            self.peak = max(self.peak, x)
            if not (self.guard and candidate):
                self.history.append(x)
                self.count += 1
                d = x - self.mean
                self.mean += d / self.count
                self.m2 += d * (x - self.mean)
        confidence = min(1.0, abs(z) / (2 * self.threshold)) if candidate else 0.0
        return mean, std, z, odd, candidate, self.streak, candidate and self.streak >= self.persist, candidate and self.streak == self.persist, confidence, len(self.history)

    def to_json(self) -> str:
        return json.dumps({"window_size": self.window, "threshold": self.threshold, "guard_baseline": self.guard, "min_pps": self.min_pps, "required_consecutive": self.persist, "count": self.count, "mean": self.mean, "m2": self.m2, "peak": self.peak, "history": list(self.history), "streak": self.streak})

    def restore(self, state: dict) -> Guarded:
        """Learned values only; the settings in force stay."""
        self.history.extend(float(x) for x in state.get("history", []))
        self.count, self.mean, self.m2, self.peak = (state.get(k, 0) for k in ("count", "mean", "m2", "peak"))
        self.streak = state.get("streak", 0)
        return self


COLUMNS = "mean double, std double, z double, stat_anomaly boolean, candidate boolean, streak long, is_threat boolean, new_threat boolean, confidence double, baseline_samples long"


def guarded(df: DataFrame, order: str, value: str, by: str, state: dict | None = None, update: bool = True, **settings) -> DataFrame:
    """A fold over each series in order: candidates are not admitted. One task a series; series run in parallel.

    state: a stored baseline to start from. update=False scores without learning.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    schema = f"`{by}` {dict(df.dtypes)[by]}, `{order}` {dict(df.dtypes)[order]}, `{value}` double, {COLUMNS}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        fold = Guarded(**settings)
        if state:
            fold.restore(state)
        out = pd.DataFrame([fold.step(float(x), update) for x in pdf[value]], columns=names)
        for c in (value, order, by):
            out.insert(0, c, pdf[c].to_numpy())
        out[value] = out[value].astype(float)
        return out

    return df.select(by, order, F.col(value).cast("double").alias(value)).groupBy(by).applyInPandas(run, schema)


def detail(verdicts: DataFrame, value: str) -> DataFrame:
    """The verdict's figures as published: z and deviation to four digits, the mean to two."""
    return verdicts.withColumn("detail", F.struct(F.round("z", 4).alias("z_score"), F.round("mean", 2).alias("mean"), F.round("std", 4).alias("std_dev"), F.col(value).alias("pps"), "baseline_samples", F.col("stat_anomaly").alias("statistical_anomaly"), F.col("candidate").alias("volume_candidate"), F.col("streak").alias("anomaly_streak"), "new_threat"))


def guarded_sql_fold(df: DataFrame, order: str, value: str, by: str, window: int = 30, threshold: float = 3.0, min_pps: float = 500.0) -> DataFrame:
    """The same flags by a JVM fold, for series of at most a few thousand rows: quadratic in the series' length."""
    series = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("x")))).alias("_series"))
    zero = F.struct(F.array().cast("array<double>").alias("h"), F.array().cast("array<struct<t:long,x:double,z:double,candidate:boolean>>").alias("out"))

    def merge(a: Column, r: Column) -> Column:
        n = F.size(a["h"])
        base = F.transform(F.array(F.aggregate(a["h"], F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))), lambda m: F.struct(m.alias("m"), F.sqrt(F.aggregate(a["h"], F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.greatest(n, F.lit(1))).alias("s")))[0]
        z = F.when((n >= 2) & (base["s"] > 0), (r["x"] - base["m"]) / base["s"]).otherwise(0.0)
        row = F.transform(F.array(z), lambda v: F.struct(r["t"].cast("long").alias("t"), r["x"].alias("x"), v.alias("z"), ((n >= WARM) & (v > threshold) & (r["x"] >= min_pps)).alias("candidate")))[0]
        return F.transform(F.array(row), lambda q: F.struct(F.when(q["candidate"], a["h"]).otherwise(F.slice(F.concat(a["h"], F.array(r["x"])), -F.least(n + 1, F.lit(window)), window)).alias("h"), F.concat(a["out"], F.array(q)).alias("out")))[0]

    return series.select(by, F.inline(F.aggregate("_series", zero, merge)["out"]))


def session_stats(df: DataFrame, order: str, value: str) -> DataFrame:
    """Mean and deviation of all rows up to and with this one."""
    # sums about the mean of all rows, one broadcast row, so that squares stay small
    df = df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_c"))))
    d = F.col(value).cast("double") - F.col("_c")
    df = running(df, order, {"_n": F.lit(1), "_x": F.col(value).cast("double"), "_d": d, "_dd": d * d})
    mean = F.col("_d") / F.col("_n")
    df = df.withColumn("session_mean", F.col("_x") / F.col("_n")).withColumn("session_std", F.sqrt(F.greatest(F.lit(0.0), F.col("_dd") / F.col("_n") - mean * mean)))
    return df.drop("_c", "_n", "_x", "_d", "_dd")


def train(df: DataFrame, order: str, value: str, label: str, window: int = 30) -> DataFrame:
    """Summary of the normal rows: count, mean, std, peak and the last ``window`` values in order."""
    normal = df.where(F.col(label) == "Normal")
    last = normal.orderBy(F.desc(order)).limit(window).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("history"))
    stats = normal.agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.greatest(F.max(value), F.lit(0)).cast("double").alias("peak"))
    return stats.crossJoin(F.broadcast(last))  # one row each


def fold_rows(values: Iterable[float], **settings) -> Iterator[tuple]:
    fold = Guarded(**settings)
    for x in values:
        yield fold.step(float(x))
