"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each whole text becomes a short vector of document statistics. Random Fourier features of the scaled
vector approximate a Gaussian kernel. The normal equations of ridge regression are summed by partition
over a bounded sample of labelled rows (``FIT_ROWS``, drawn by a hash of doc_id) and solved on the driver;
pool-adjacent-violators on another half of that sample turns raw scores into probabilities, interpolated
between blocks so that the order of scores is kept.

Defined results: null or empty text is scored from its statistics, which are zero; repeated labels of a
doc_id are averaged; null labels are skipped; without labels of both classes every score is the share of
label 1 (0.5 where there are none); ties in score stay ties; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, saved, table

#: Most labelled rows that the fit and the calibration see together.
FIT_ROWS = 60_000
FOURIER = 192
RIDGE = 1e-3
WIDTH = 1.5
FEATURES = ("log_chars", "log_words", "word_mean", "word_std", "upper", "digit", "punct", "symbol", "space", "line", "high", "distinct", "log_repeat", "compression", "longest", "short", "comma_dot", "word_char_end")
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:'\"?()-", 3), (b"!#$%&*+/<=>@[\\]^_`{|}~", 4), (b" \t\r\x0b\x0c", 5), (b"\n", 6), (bytes(range(128, 256)), 7)):
    _CLASS[list(_chars)] = _k


def statistics(text: str | None) -> list[float]:
    """Scale-free statistics of the whole text; no metadata."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=hist, minlength=8) / len(raw)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    kinds = len(set(words))
    z = zlib.compressobj(1)
    packed = len(z.compress(raw)) + len(z.flush())
    ends = sum(w[-1:].isalnum() for w in words) / n if n else 0.0
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        share[1], share[2], share[3], share[4], share[5], share[6] * 10, share[7],
        kinds / n if n else 0.0, float(np.log((n + 1) / (kinds + 1))), packed / (len(raw) + 20),
        float(np.log1p(lengths.max())), float((lengths <= 3).mean()), float((hist[44] + hist[46]) / max(n, 1)), ends,
    ]


def statistics_of(docs: DataFrame, label: str) -> DataFrame:
    """doc_id, y, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["doc_id", "y", "x"])

    return docs.select("doc_id", F.col(label).cast("double"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, y double, x array<double>")


class Model:
    def __init__(self, mean: np.ndarray, std: np.ndarray, fourier: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / (WIDTH * np.sqrt(len(mean))), (len(mean), fourier))
        self.b = rng.uniform(0, 2 * np.pi, fourier)
        self.coef = np.zeros(fourier + 1)
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.x, self.y), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; block centres and values, with the ends open so that order is never lost."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for i in order:
        blocks.append([float(y[i]), 1.0, float(raw[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x = np.array([b[2] / b[1] for b in blocks])
    v = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])
    v = np.maximum.accumulate(v)
    return np.concatenate([[x[0] - 2.0], x, [x[-1] + 2.0]]), np.concatenate([[v[0] * 0.5], v, [0.5 + v[-1] * 0.5]])


def rows_of(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fourier: int = FOURIER) -> Model:
    """docs: doc_id, text. labels: doc_id, quality; labels of the held-out fold are never read."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    marks = marks.where(draw < min(1.0, fit_rows / max(n, 1)))
    # about fit_rows ids and labels at most, 16 bytes each: a bound that no input passes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(saved(marks, "marks")), "doc_id")
    rows = statistics_of(rows, "y").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    rows = saved(rows, "labelled")
    k = range(len(FEATURES))
    got = rows.agg(F.count("*"), F.avg("y"), *[F.avg(F.col("x")[i]) for i in k], *[F.stddev_pop(F.col("x")[i]) for i in k]).first()
    if not got[0]:
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), fourier)
    model = Model(np.array(got[2 : 2 + len(FEATURES)]), np.array(got[2 + len(FEATURES) :]), fourier)
    model.y = np.array([got[1], got[1]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = fourier + 1
        a, c, m = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            f, y = model.map(rows_of(b, 0)), b.column(1).to_numpy()
            a, c, m = a + f.T @ f, c + f.T @ y, m + len(y)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["m", "a", "c"])

    # at most fit_rows rows, so a few partitions hold them and as many sums reach the driver
    parts = rows.where("half = 0").select("x", "y").coalesce(8).mapInArrow(sums, "m long, a binary, c binary").collect()
    if not parts or got[1] in (0.0, 1.0):
        return model
    a = sum(np.frombuffer(p["a"]).reshape(fourier + 1, -1) for p in parts)
    c, m = sum(np.frombuffer(p["c"]) for p in parts), sum(p["m"] for p in parts)
    model.coef = np.linalg.solve(a / m + RIDGE * np.eye(fourier + 1), c / m)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(rows_of(b, 0)), pa.float64()), b.column(1)], ["raw", "y"])

    # two numbers for each of at most fit_rows rows
    rest = rows.where("half = 1").select("x", "y").mapInArrow(raws, "raw double, y double").toArrow()
    if rest.num_rows:
        model.x, model.y = isotonic(rest["raw"].to_numpy(), rest["y"].to_numpy())
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of docs' rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(np.array([statistics(t.as_py()) for t in b.column(1)]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def at_least(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs (text among their columns, which stay as they are) that reach the score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(np.array([statistics(t.as_py()) for t in b.column(at)])) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted for every row of docs; the text is read once more than the fitted sample."""
    return scored(docs, fit(docs, labels)).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
