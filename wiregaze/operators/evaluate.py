"""Confusion matrices, scores, rankings, splits and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import hash_rank


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn; truth and predicted are booleans."""
    return df.groupBy(*by or []).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))


def scores(cm: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    total = tp + fp + fn + tn
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    prevalence = div(tp + fn, total)
    values = {
        "precision": precision, "recall": recall, "specificity": specificity, "f1": div(2 * precision * recall, precision + recall), "accuracy": div(tp + tn, total),
        "balanced_accuracy": (recall + specificity) / 2, "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "prevalence": prevalence, "no_skill_f1": div(2 * prevalence, prevalence + 1),
    }
    return cm.select("*", *[F.round(v, 4).alias(k) for k, v in values.items()])


def rank(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("f1"), F.desc("recall"))


def report(results: DataFrame) -> DataFrame:
    """engine and its scores -> engine, lines of text; a score no better than guessing the majority is marked."""
    shown = [("True Positives", "tp"), ("False Positives", "fp"), ("False Negatives", "fn"), ("True Negatives", "tn")]
    rates = [("Precision", "precision"), ("Recall", "recall"), ("Specificity", "specificity"), ("F1", "f1"), ("Accuracy", "accuracy"), ("Balanced accuracy", "balanced_accuracy"), ("MCC", "mcc"), ("Prevalence", "prevalence"), ("No-skill F1", "no_skill_f1")]
    lines = [F.concat(F.lit("--- "), "engine", F.lit(" ---"))]
    lines += [F.format_string(f"{n}: %d", F.col(c).cast("long")) for n, c in shown] + [F.format_string(f"{n}: %.4f", F.col(c).cast("double")) for n, c in rates]
    poor = F.col("f1") <= F.col("no_skill_f1")
    lines += [F.when(poor, "F1 does not beat the no-skill baseline")]
    return results.select("engine", poor.alias("no_better_than_guessing"), F.concat_ws("\n", *lines).alias("report"))


def two_sided(rows: DataFrame, order: str, value: str, label: str = "label", window: int = 30, warmup: int = 100, threshold: float = 3.0, flat: bool = False) -> DataFrame:
    """Adds z and predicted ("Attack" or "Normal") against a frozen baseline: the last ``window`` of the first ``warmup`` normal rows.

    z is null where there are no normal rows. A deviation of zero gives 0, or with flat what dividing gives: infinity, NaN at
    the mean, both beyond the threshold.
    """
    first = rows.where(F.col(label) == "Normal").orderBy(order).limit(warmup)
    newest = F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("double").alias("x"))), asc=False)
    base = first.orderBy(F.desc(order)).limit(window).agg(moments(F.transform(newest, lambda r: r["x"])).alias("_b"))
    df = rows.crossJoin(F.broadcast(base))  # one row
    n, m, s, x = F.col("_b.n"), F.col("_b.mean"), F.col("_b.std"), F.col(value)
    even = F.when(x == m, float("nan")).otherwise(float("inf")) if flat else F.lit(0.0)
    z = F.when(s > 0, F.abs((x - m) / s)).when(n > 0, even)
    return df.withColumn("z", z).withColumn("predicted", F.when(F.col("z") > threshold, "Attack").otherwise("Normal")).drop("_b")


def moments(values: Column) -> Column:
    """n, mean and population deviation of a short array, by Welford's steps in its order, as SQL takes them; null where it is empty."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("sum"))

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean)).alias("m2"), (a["sum"] + x).alias("sum"))

    some = lambda a, v: F.when(a["n"] > 0, v / F.greatest(a["n"], F.lit(1)))
    return F.aggregate(values, zero, add, lambda a: F.struct(a["n"].alias("n"), some(a, a["sum"]).alias("mean"), F.sqrt(some(a, a["m2"])).alias("std")))


def best(results: DataFrame) -> DataFrame:
    return rank(results).limit(1)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def row_key(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def distinct_rows(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, in order, of each trimmed key; min_by keeps it to one aggregation with map-side combine."""
    packed = F.struct(*df.columns)
    return df.withColumn("_k", row_key(columns)).groupBy("_k").agg(F.min_by(packed, F.col(order)).alias("r")).select("r.*")


def split(df: DataFrame, columns: list[str], label: str, seed: str, dataset: str) -> DataFrame:
    """Adds split: train, validation or test, by hash rank within the label, 70 : 15 : 15."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.lit(dataset), row_key(columns)), 256)
    df = hash_rank(df.withColumn("_h", digest), "_h", "_i", (label,), "_n")
    t = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.70)))
    v = F.greatest(F.lit(1), F.floor((F.col("_n") - t) / 2))
    t = F.when(F.col("_n") - t - v <= 0, t - 1).otherwise(t)
    name = F.when(F.col("_n") == 1, "train").when(F.col("_n") == 2, F.when(F.col("_i") == 0, "train").otherwise("test"))
    name = name.when(F.col("_i") < t, "train").when(F.col("_i") < t + v, "validation").otherwise("test")
    return df.withColumn("split", name).drop("_h", "_n", "_i")


def overlap(splits: DataFrame, columns: list[str]) -> DataFrame:
    """Keys in more than one split; none in a sound split."""
    return splits.groupBy(row_key(columns).alias("key")).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def rebalance(series: DataFrame, order: str, benign_ratio: float = 0.95, warmup: int = 30, seed: int = 1) -> DataFrame:
    """``warmup`` benign rows in order, then all benign rows mixed with attacks sampled down to the ratio, in hash order.

    The warm-up rows come again in the mix, as in the published figures.
    """
    benign, attack = series.where("label = 'Normal'"), series.where("label <> 'Normal'")
    nb, na = benign.count(), attack.count()
    keep = min(na, max(1, int(nb * (1 - benign_ratio) / benign_ratio))) if na else 0
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")))
    first = benign.orderBy(order).limit(warmup).select("*", F.lit(0).alias("part"), F.col(order).cast("long").alias("pos"))
    taken = hash_rank(attack.withColumn("_h", h), "_h", "_i").where(F.col("_i") < keep).drop("_h", "_i")
    # sixteen hex digits of the hash less the sign give the place
    place = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    mix = benign.unionByName(taken).select("*", F.lit(1).alias("part"), place.alias("pos"))
    return first.unionByName(mix)
