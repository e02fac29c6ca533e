"""Port-scan classification by weighted nearest neighbours over (ports, packets, ports / packets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import KNN_SEED
from ..functions.scalars import plausible_scan
from .ordered import rank

MAX_TRAINING = 5000


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(KNN_SEED)], "row_no long, unique_ports long, packet_count long, label string")


def sanitise(rows: DataFrame) -> DataFrame:
    """Rows with usable numbers; label Scan only where a scan is plausible. ``corrected`` marks changed labels."""
    p, n = (F.expr(f"try_cast({c} as double)") for c in ("unique_ports", "packet_count"))
    df = rows.withColumns({"_p": p, "_n": n}).where("_p is not null and _n is not null and not isnan(_p) and not isnan(_n) and abs(_p) < double('infinity') and abs(_n) < double('infinity')")
    df = df.where("_p >= 0 and _n > 0 and _p <= _n")
    said = F.lower(F.trim("label")) == "scan"
    ok = plausible_scan(F.col("_p"), F.col("_n"))
    return df.select("row_no", F.col("_p").alias("unique_ports"), F.col("_n").alias("packet_count"), F.when(said & ok, "Scan").otherwise("Normal").alias("label"), (said & ~ok).alias("corrected"))


def thin(rows: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """At most about ``most`` rows, evenly from each class in order."""
    if rows.count() <= most:
        return rows
    classes = rows.select("label").distinct().count()
    per = max(1, most // classes)
    df = rank(rows, "row_no", "_i", ("label",), total="_all")
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / per))
    return df.where((F.col("_i") % step == 0) & (F.col("_i") / step < per)).drop("_i", "_all")


def from_brain(spark: SparkSession, brain: dict) -> DataFrame:
    """Training rows of a stored model, sanitised again; the built-in ones where none of them is valid."""
    stored = [(i, *(None if v is None else str(v) for v in (*r, None, None, None)[:3])) for i, r in enumerate(brain.get("training_data") or [])]
    rows = sanitise(spark.createDataFrame(stored, "row_no long, unique_ports string, packet_count string, label string")) if stored else None
    return seed(spark) if rows is None or rows.isEmpty() else rows.drop("corrected")


def ratio(ports: Column, packets: Column) -> Column:
    return F.when(packets > 0, ports / packets).otherwise(0.0)


def ranges(train: DataFrame) -> DataFrame:
    r = ratio(F.col("unique_ports"), F.col("packet_count"))
    return train.agg(*[f(c).cast("double").alias(f"{k}_{n}") for n, c in (("ports", F.col("unique_ports")), ("packets", F.col("packet_count")), ("ratio", r)) for k, f in (("min", F.min), ("max", F.max))])


def model(train: DataFrame) -> DataFrame:
    """One row: ranges and the training rows scaled by them, as arrays. More than MAX_TRAINING rows are thinned: its size is bounded."""
    train = thin(train)
    r = F.broadcast(ranges(train))
    f = train.crossJoin(r)
    scaled = [scale(c, n) for c, n in ((F.col("unique_ports").cast("double"), "ports"), (F.col("packet_count").cast("double"), "packets"), (ratio(F.col("unique_ports"), F.col("packet_count")), "ratio"))]
    names = [f"{k}_{n}" for n in ("ports", "packets", "ratio") for k in ("min", "max")]
    return f.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("row_no", scaled[0].alias("a"), scaled[1].alias("b"), scaled[2].alias("c"), (F.col("label") == "Scan").alias("scan")))).alias("rows"))


def scale(x: Column, name: str) -> Column:
    low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def classify(points: DataFrame, train: DataFrame, k: int = 3, ports: str = "unique_ports", packets: str = "packets") -> DataFrame:
    """Adds label and confidence. The training rows ride along as one broadcast row; no pairs are shuffled."""
    known = model(train)
    df = points.crossJoin(F.broadcast(known))
    p, n = F.col(ports).cast("double"), F.col(packets).cast("double")
    q = [scale(p, "ports"), scale(n, "packets"), scale(ratio(p, n), "ratio")]
    df = df.withColumns({f"_q{i}": c for i, c in enumerate(q)}).withColumn("_ok", plausible_scan(p, n))
    near = F.transform("rows", lambda r: F.struct(F.sqrt(sum((r[x] - F.col(f"_q{i}")) * (r[x] - F.col(f"_q{i}")) for i, x in enumerate("abc"))).alias("d"), r["row_no"].alias("row_no"), r["scan"].alias("scan")))
    # rows that cannot be scans never pay for the distances
    df = df.withColumn("_near", F.when(F.col("_ok"), F.slice(F.array_sort(near), 1, k)))
    weight = lambda which: F.aggregate(F.filter("_near", lambda r: r["scan"] == which), F.lit(0.0), lambda a, r: a + 1 / (r["d"] + 1e-9))
    scan = F.coalesce(weight(F.lit(True)) > weight(F.lit(False)), F.lit(False))
    df = df.withColumn("_scan", scan)
    share = F.size(F.filter("_near", lambda r: r["scan"] == F.col("_scan"))) / F.size("_near")
    drop = [*known.columns, "_q0", "_q1", "_q2", "_ok", "_near", "_scan"]
    return df.withColumn("label", F.when(F.col("_scan"), "Scan").otherwise("Normal")).withColumn("confidence", F.when(F.col("_ok"), share).otherwise(0.0)).drop(*drop)
