"""Files that queries write for themselves: in the shared checkpoint folder, or a local one where it is unset."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from ..sources.pcap import header, record


def folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; executors need a folder that they share")
    base = base or "file://" + tempfile.mkdtemp(prefix="wiregaze-")
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


def csv_file(df: DataFrame) -> str:
    path = folder(df.sparkSession)
    df.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once, for plans that read it in several branches; each branch reads its own columns."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def capture_file(frames: DataFrame) -> str:
    """A capture through Spark's file system, record by record."""
    spark = frames.sparkSession
    path = folder(spark) + "/capture.pcap"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(header(200)))
    rows = frames.toLocalIterator()
    while some := list(islice(rows, 10_000)):
        out.write(bytearray(b"".join(record(r["ts_us"], bytes(r["raw"]), r["orig_len"], 200) for r in some)))
    out.close()
    return path


def run_stream(rows: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a streaming plan over the rows until none are left, and read its output."""
    spark = rows.sparkSession
    base = folder(spark)
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    q = plan(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
