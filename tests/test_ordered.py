"""Two-level ranks and running values against plain ones, over small blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wiregaze.operators import evaluate, intervals, ordered, zscore


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    places = random.sample(range(5000), 700)
    return spark.createDataFrame([(p, random.choice(["a", "b", None]), random.randint(-50, 50), f"{random.getrandbits(64):016x}") for p in places], "no long, label string, x long, digest string").repartition(5)


def test_rank(rows):
    for block in (None, F.floor(F.col("no") / 37)):
        got = ordered.rank(rows, "no", "i", ("label",), block, "n").collect()
        for label in ("a", "b", None):
            own = sorted((r["no"], r["i"], r["n"]) for r in got if r["label"] == label)
            assert [i for _, i, _ in own] == list(range(len(own))) and {n for _, _, n in own} == {len(own)}
    got = ordered.hash_rank(rows, "digest", "i").collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["digest"])] == list(range(700))


@pytest.mark.parametrize("size", [1, 90, 1 << 16])
def test_running(rows, size):
    got = sorted((r["no"], r["s"], r["m"]) for r in ordered.running(ordered.running(rows, "no", {"s": F.col("x")}, size=size), "no", {"m": F.when(F.col("x") > 0, F.col("x"))}, "max", size).collect())
    want, s, m = [], 0, None
    for r in sorted(rows.collect(), key=lambda r: r["no"]):
        s += r["x"]
        m = max(m or r["x"], r["x"]) if r["x"] > 0 else m
        want.append((r["no"], s, m))
    assert got == want


def test_late_records_join_the_newest_second(spark):
    """The running maximum of the seconds in the order of the capture."""
    times = [0, 400_000, 1_200_000, 900_000, 3_000_000, 2_500_000, 1_000_000, 3_400_000]
    df = spark.createDataFrame(list(enumerate(times, 1)), "no long, ts_us long")
    got = [r["second"] for r in intervals.assign_seconds(df, in_order=True).orderBy("no").collect()]
    assert got == [0, 0, 1, 1, 3, 3, 3, 3]


def test_naive_scores_across_blocks(spark, monkeypatch):
    """Windows and streaks that cross the edges of blocks are those of one window over all rows."""
    random.seed(1)
    series = [(i * 3, float(random.choice([5, 6, 7, 8, 60]))) for i in range(400)]
    df = spark.createDataFrame(series, "hour long, pps double")
    real = ordered.with_context
    monkeypatch.setattr(zscore, "with_context", lambda d, p, c: real(d, p, c, 47))
    keys = ["hour", "mean", "std", "z", "candidate", "streak", "is_threat", "new_threat"]
    args = {"window": 30, "threshold": 1.5, "min_pps": 0.0, "persist": 2}
    got = zscore.naive(df, "hour", "pps", **args)
    want = zscore.naive(df.withColumn("one", F.lit(1)), "hour", "pps", ["one"], **args)
    assert got.columns == df.columns + keys[1:]
    near = lambda rs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs.select(*keys).collect())
    assert near(got) == near(want) and got.where("streak > 2").count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(hour" not in plan


def test_session_stats(spark):
    df = spark.createDataFrame([(i, float(1_000_000 + i % 7)) for i in range(300)], "t long, v double")
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["t"]: (r["m"], r["s"]) for r in df.select("t", F.avg("v").over(w).alias("m"), F.stddev_pop("v").over(w).alias("s")).collect()}
    for r in zscore.session_stats(df, "t", "v").collect():
        assert abs(r["session_mean"] - want[r["t"]][0]) < 1e-6 and abs(r["session_std"] - want[r["t"]][1]) < 1e-6


def test_split_shares_and_rebalance(rows):
    got = evaluate.split(rows, ["no"], "label", "s", "d")
    assert got.count() == 700 and got.columns == [*rows.columns, "split"]
    for r in got.groupBy("label").pivot("split").count().collect():
        n = r["train"] + r["validation"] + r["test"]
        assert r["train"] == int(n * 0.7) and abs(r["validation"] - r["test"]) <= 1
    series = rows.select("no", F.when(F.col("x") < 20, "Normal").otherwise("DDoS").alias("label"))
    mix = evaluate.rebalance(series, "no")
    normal = series.where("label = 'Normal'").count()
    assert mix.where("part = 0").count() == 30 and mix.where("part = 1 and label = 'Normal'").count() == normal
    assert mix.where("label = 'DDoS'").count() == int(normal * 0.05 / 0.95)
