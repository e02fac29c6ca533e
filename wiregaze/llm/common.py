"""Shared helpers: scratch tables in the shared checkpoint folder, table reading, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            base = jdir.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; executors need a folder that they share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="wiregaze-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/wiregaze/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of a loop: each round's table takes the place of the last one's, whose files go once it is written.

    No plan may read a table after the next one is put.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        old, self.path = self.path, path
        if old:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(k))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of any 64-bit ids -> (node, root), root = smallest reachable id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is two
    aggregations and joins, written to the shared folder; nothing but one counter per round reaches
    the driver. A hub's rows are joined, never grouped into one task, so AQE can split them.
    Links of a node to itself keep it in the result. An empty input gives an empty result.
    """
    e = saved(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "links")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    cur = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars, last = Rounds(edges.sparkSession, "stars"), None
    for _ in range(max_rounds):
        # large star: every node hands its larger neighbours to its smallest one
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node hands its smaller neighbours, and itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        cur = stars.put(small.distinct())
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("connected components did not settle")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
