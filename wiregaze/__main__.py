"""python -m wiregaze replay CAPTURE | train --out BASE [--knn F] [--payload F] [--kmeans F] [--zscore F] [--bloom F] | evaluate [the same files] | drift BRAIN..."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .plans import models
from .plans.replay import engine_hits, replay, timeline
from .sources import sinks, tabular
from .sources.pcap import read_pcap

KINDS = ("knn", "payload", "kmeans", "zscore", "bloom")


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="wiregaze")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("replay").add_argument("capture")
    for name in ("train", "evaluate"):
        q = sub.add_parser(name)
        for k in KINDS:
            q.add_argument(f"--{k}")
        if name == "train":
            q.add_argument("--out", required=True)
            q.add_argument("--note", default="")
    sub.add_parser("drift").add_argument("brains", nargs="+")
    return p.parse_args(argv)


def tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    return {k: getattr(tabular, f"load_{k}_csv")(spark, path) for k in KINDS if (path := getattr(args, k))}


def drift(brains: list[dict]) -> list[tuple[int, int, float, float]]:
    """version, cluster, pps, unique_ports: how the centroids moved."""
    return [(i, k, float(c[0]), float(c[1])) for i, b in enumerate(brains) for k, c in enumerate(b.get("kmeans", {}).get("centroids", []))]


def evaluated(rows: dict[str, DataFrame]) -> DataFrame:
    run = {"knn": models.evaluate_knn, "payload": models.evaluate_payload, "kmeans": models.evaluate_kmeans, "zscore": models.evaluate_zscore, "bloom": lambda r: models.evaluate_bloom(r)["scores"]}
    return reduce(DataFrame.unionByName, [run[k](r).withColumn("engine", F.lit(k)) for k, r in rows.items()])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("wiregaze").getOrCreate()
    if args.command == "replay":
        alerts = replay(read_pcap(spark, args.capture))
        engine_hits(alerts).show(truncate=False)
        timeline(alerts).select("t", "technique_id", "severity", "risk_score", "message").show(truncate=False)
    elif args.command == "drift":
        spark.createDataFrame(drift([json.loads(open(b).read()) for b in args.brains]), "version int, cluster int, pps double, unique_ports double").show()
    else:
        rows = tables(spark, args)
        if not rows:
            print("no input files", file=sys.stderr)
            return 2
        if args.command == "train":
            print(sinks.write_brain(models.train_brain(**{f"{k}_rows": r for k, r in rows.items()}, note=args.note), args.out))
        else:
            got = evaluated(rows)
            for r in evaluate.report(got).collect():  # a row a detector
                print(r["report"], end="\n\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
