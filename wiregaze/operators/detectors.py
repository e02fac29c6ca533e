"""One contract for the five detectors: score a table, fit from labelled rows, go to a stored model and back, start anew.

A sixth detector is one more class with these methods. ``score`` adds a struct ``verdict`` (label, confidence, is_threat).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PRIORS
from . import bayes, bloom, kmeans, knn, zscore


class Detector(Protocol):
    name: str

    def score(self, df: DataFrame) -> DataFrame: ...

    def fit(self, rows: DataFrame) -> Detector: ...

    def to_brain(self) -> dict[str, Any]: ...

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> Detector: ...

    def reset(self) -> Detector: ...


def verdict(label: Column, confidence: Column, threat: Column) -> Column:
    return F.struct(label.alias("label"), confidence.alias("confidence"), threat.alias("is_threat")).alias("verdict")


@dataclass
class ZScore:
    """df: ``by``, ``order``, pps. One fold a series."""

    name = "z_score"
    by: str = "series"
    order: str = "second"
    settings: dict[str, Any] = field(default_factory=dict)
    state: dict[str, Any] | None = None

    def score(self, df: DataFrame) -> DataFrame:
        got = zscore.guarded(df, self.order, "pps", self.by, self.state, **self.settings)
        return got.withColumn("verdict", verdict(F.when(F.col("is_threat"), "DDoS").otherwise("Normal"), F.col("confidence"), F.col("is_threat")))

    def fit(self, rows: DataFrame) -> ZScore:
        s = zscore.train(rows, self.order, "pps", "label").first()
        self.state = {"count": s["count"], "mean": s["mean"], "m2": (s["std"] or 0.0) ** 2 * s["count"], "peak": s["peak"], "history": s["history"]}
        return self

    def to_brain(self) -> dict[str, Any]:
        return dict(self.state or {})

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> ZScore:
        self.state = dict(brain) or None
        return self

    def reset(self) -> ZScore:
        self.state = None
        return self


@dataclass
class Scan:
    """df: unique_ports, packets."""

    name = "knn"
    k: int = 3
    train: DataFrame | None = None

    def score(self, df: DataFrame) -> DataFrame:
        got = knn.classify(df, self.train if self.train is not None else knn.seed(df.sparkSession), self.k)
        return got.withColumn("verdict", verdict(F.col("label"), F.col("confidence"), F.col("label") == "Scan")).drop("label", "confidence")

    def fit(self, rows: DataFrame) -> Scan:
        self.train = knn.thin(knn.sanitise(rows)).drop("corrected")
        return self

    def to_brain(self) -> dict[str, Any]:
        rows = [] if self.train is None else self.train.orderBy("row_no").collect()  # thinned: a bounded number
        return {"k": self.k, "training_data": [[r["unique_ports"], r["packet_count"], r["label"]] for r in rows]}

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> Scan:
        self.train = knn.from_brain(spark, brain)
        return self

    def reset(self) -> Scan:
        self.train = None
        return self


@dataclass
class Payload:
    """df: a column of payloads."""

    name = "naive_bayes"
    payload: str = "payload"
    vocab: DataFrame | None = None
    priors: tuple[float, float] = PRIORS

    def score(self, df: DataFrame) -> DataFrame:
        got = bayes.score(df, self.payload, self.vocab, self.priors)
        return got.select(*df.columns, "keywords", verdict(F.col("verdict"), F.col("confidence"), F.col("verdict") == "Malicious"))

    def fit(self, rows: DataFrame) -> Payload:
        words = [r["word"] for r in bayes.vocabulary(rows.sparkSession).collect()] + [r["word"] for r in bayes.discover(rows, self.payload).collect()]
        p = bayes.prior(rows).first()[0]
        self.vocab, self.priors = bayes.train(rows, words, self.payload), (p, 1 - p)
        return self

    def to_brain(self) -> dict[str, Any]:
        return {"prior_malicious": self.priors[0], "prior_safe": self.priors[1], "likelihoods": {w: [a, b] for w, a, b in bayes.as_rows(self.vocab)}}

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> Payload:
        self.vocab, self.priors = bayes.from_brain(spark, brain)
        return self

    def reset(self) -> Payload:
        self.vocab, self.priors = None, PRIORS
        return self


@dataclass
class Drift:
    """df: ``by``, ``order``, pps, unique_ports. One fold a series."""

    name = "kmeans"
    by: str = "series"
    order: str = "second"
    brain: dict[str, Any] | None = None

    def score(self, df: DataFrame) -> DataFrame:
        got = kmeans.novelty(df, self.order, self.by, start=self.brain)
        return got.withColumn("verdict", verdict(F.when(F.col("is_threat"), "Anomaly").otherwise("Normal"), F.col("confidence"), F.col("is_threat")))

    def fit(self, rows: DataFrame) -> Drift:
        self.brain = kmeans.train(rows.where("label = 'Normal'"), self.order)
        return self

    def to_brain(self) -> dict[str, Any]:
        return self.brain or kmeans.Novelty().to_dict()

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> Drift:
        self.brain = dict(brain) if brain.get("centroids") else None
        return self

    def reset(self) -> Drift:
        self.brain = None
        return self


@dataclass
class Reputation:
    """df: a column of addresses."""

    name = "bloom"
    item: str = "ip"
    bits: list[int] = field(default_factory=list)
    items_added: int = 0

    def score(self, df: DataFrame) -> DataFrame:
        hit = bloom.check(df, self.item, self.bits)
        own = bloom.verdict(hit, (len(self.bits) / bloom.SIZE) ** bloom.HASHES)
        return df.withColumn("verdict", verdict(own["label"], own["confidence"], hit))

    def fit(self, rows: DataFrame) -> Reputation:
        f = bloom.train(rows, self.item).first()
        self.bits, self.items_added = list(f["bits"] or []), f["items_added"]
        return self

    def to_brain(self) -> dict[str, Any]:
        return {"size": bloom.SIZE, "hash_count": bloom.HASHES, "items_added": self.items_added, "bits": bloom.to_hex(self.bits)}

    def from_brain(self, spark: SparkSession, brain: dict[str, Any]) -> Reputation:
        self.bits, self.items_added = bloom.from_hex(brain.get("bits", "")) or [], int(brain.get("items_added", 0))
        return self

    def reset(self) -> Reputation:
        self.bits, self.items_added = [], 0
        return self


def detectors() -> dict[str, Detector]:
    return {d.name: d for d in (ZScore(), Scan(), Payload(), Drift(), Reputation())}
