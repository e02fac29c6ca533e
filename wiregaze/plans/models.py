"""Training, evaluation and the model bundle ("brain") as JSON."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LIKELIHOODS, PRIORS
from ..operators import bayes, bloom, evaluate, kmeans, knn, ordered, zscore


def evaluate_knn(rows: DataFrame, train: DataFrame | None = None, k: int = 3) -> DataFrame:
    got = knn.classify(rows.withColumnRenamed("label", "truth"), train if train is not None else knn.seed(rows.sparkSession), k, packets="packet_count")
    return evaluate.scores(evaluate.confusion(got, F.col("truth") == "Scan", F.col("label") == "Scan"))


def evaluate_payload(rows: DataFrame, vocab: DataFrame | None = None, priors: tuple[float, float] = PRIORS) -> DataFrame:
    got = bayes.score(rows, "payload", vocab, priors)
    return evaluate.scores(evaluate.confusion(got, bayes.positive(F.col("label")), F.col("verdict") == "Malicious"))


def evaluate_zscore(rows: DataFrame, guard: bool = True, **settings) -> DataFrame:
    """Every candidate counts; rows in file order."""
    settings = {"min_pps": 0.0, "persist": 1} | settings
    got = zscore.guarded(rows.withColumn("series", F.lit(0)), "row_no", "pps", "series", guard=guard, **settings).join(rows.select("row_no", "label"), "row_no")
    return evaluate.scores(evaluate.confusion(got, F.col("label") != "Normal", F.col("candidate")))


def evaluate_kmeans(rows: DataFrame, brain: dict | None = None) -> DataFrame:
    got = kmeans.novelty(rows.withColumn("series", F.lit(0)), "row_no", "series", start=brain).join(rows.select("row_no", "label"), "row_no")
    return evaluate.scores(evaluate.confusion(got, F.col("label") != "Normal", F.col("is_threat")))


def evaluate_bloom(rows: DataFrame, share: float = 0.5, size: int = bloom.SIZE, hashes: int = bloom.HASHES) -> dict:
    """The first ``share`` of the malicious rows is loaded; the others are only counted as held-out hits."""
    bad = ordered.rank(rows.where(~bloom.safe_label(F.col("label"))), "row_no", "_place")
    n = bad.count()
    loaded = bad.where(F.col("_place") < max(1, int(n * share)))
    f = bloom.build(loaded, "ip", size, hashes)
    bits = bloom.bits_of(f)
    held = bad.join(loaded.select("row_no"), "row_no", "left_anti")
    benign = rows.where(bloom.safe_label(F.col("label"))).join(bad.select("ip"), "ip", "left_anti")
    tested = loaded.select("ip", F.lit(True).alias("truth")).union(benign.select("ip", F.lit(False)))
    cm = evaluate.scores(evaluate.confusion(tested, F.col("truth"), bloom.check(tested, "ip", bits, size, hashes)))
    return {"scores": cm, "saturation": len(bits) / size, "false_positive_rate": (len(bits) / size) ** hashes, "held_out": held.count(), "leaked": held.where(bloom.check(held, "ip", bits, size, hashes)).count()}


def train_brain(knn_rows: DataFrame | None = None, payload_rows: DataFrame | None = None, kmeans_rows: DataFrame | None = None, zscore_rows: DataFrame | None = None, bloom_rows: DataFrame | None = None, note: str = "") -> dict:
    """Only tables of bounded size (thinned rows, vocabulary, centroids, bits) reach the driver."""
    brain: dict = {}
    if knn_rows is not None:
        rows = knn.thin(knn.sanitise(knn_rows)).orderBy("row_no").collect()
        brain["knn"] = {"k": 3, "training_data": [[r["unique_ports"], r["packet_count"], r["label"]] for r in rows]}
    if payload_rows is not None:
        words = [w for w, _, _ in LIKELIHOODS] + [r["word"] for r in bayes.discover(payload_rows).collect()]
        vocab = bayes.train(payload_rows, words)
        p = bayes.prior(payload_rows).first()[0]
        brain["payload"] = {"prior_malicious": p, "prior_safe": 1 - p, "likelihoods": {w: [a, b] for w, a, b in bayes.as_rows(vocab)}}
    if kmeans_rows is not None:
        brain["kmeans"] = kmeans.train(kmeans_rows.where("label = 'Normal'"), "row_no")
    if zscore_rows is not None:
        s = zscore.train(zscore_rows, "row_no", "pps", "label").first()
        brain["z_score"] = {"window_size": 30, "threshold": 3.0, "guard_baseline": True, "count": s["count"], "mean": s["mean"], "m2": s["std"] ** 2 * s["count"], "peak": s["peak"], "history": s["history"]}
    if bloom_rows is not None:
        f = bloom.train(bloom_rows).first()
        brain["bloom"] = {"size": bloom.SIZE, "hash_count": bloom.HASHES, "items_added": f["items_added"], "bits": bloom.to_hex(f["bits"])}
    brain["_meta"] = {"trained_at": datetime.now(timezone.utc).isoformat(), "engines": [k for k in brain], "note": note}
    return brain


def source_record(rows: DataFrame, label: str = "label") -> DataFrame:
    return evaluate.class_distribution(rows, label)


def file_digest(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
