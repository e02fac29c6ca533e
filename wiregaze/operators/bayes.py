"""Payload scoring with naive Bayes over contained words, its training and vocabulary discovery."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.constants import LIKELIHOODS, NEWER_LETTERS, PRIORS, WEAK_WORDS


@pandas_udf(T.StringType())
def utf8_ignore(raw):  # the JVM's decoders replace or refuse bad bytes; here they are left out
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(LIKELIHOODS)], "ord int, word string, p_mal double, p_safe double")


def as_rows(vocab: DataFrame | None) -> list[tuple[str, float, float]]:
    """A vocabulary table as literals; it is a model of at most a few thousand words."""
    if vocab is None:
        return list(LIKELIHOODS)
    return [(r["word"], r["p_mal"], r["p_safe"]) for r in vocab.where("p_mal > 0 and p_safe > 0").orderBy("ord").collect()]


def score(df: DataFrame, payload: str, vocab: DataFrame | None = None, priors: tuple[float, float] = PRIORS, least: float = 0.80) -> DataFrame:
    """Adds verdict, confidence and keywords (in vocabulary order). A text shorter than 3 is Safe with confidence 0."""
    rows = as_rows(vocab)
    text = utf8_ignore(F.col(payload)) if dict(df.dtypes)[payload] == "binary" else F.col(payload)
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(math.log(a)).alias("m"), F.lit(math.log(b)).alias("s")) for w, a, b in rows])
    df = df.withColumn("_t", F.upper(F.coalesce(text, F.lit("")))).withColumn("_v", words)
    df = df.withColumn("_hit", F.when(F.char_length("_t") >= 3, F.filter("_v", lambda v: F.contains(F.col("_t"), v["w"]))).otherwise(F.slice("_v", 1, 0))).drop("_v")
    add = lambda start, k: F.aggregate("_hit", F.lit(math.log(start)), lambda a, v: a + v[k])
    df = df.withColumn("_m", add(priors[0], "m")).withColumn("_s", add(priors[1], "s"))
    top = F.greatest("_m", "_s")
    conf = F.when(F.char_length("_t") < 3, 0.0).otherwise(F.exp(F.col("_m") - top) / (F.exp(F.col("_m") - top) + F.exp(F.col("_s") - top)))
    df = df.withColumn("confidence", conf).withColumn("keywords", F.transform("_hit", lambda v: v["w"]))
    strong = F.exists("keywords", lambda w: ~w.isin(*WEAK_WORDS))
    return df.withColumn("verdict", F.when((F.col("confidence") >= least) & strong, "Malicious").otherwise("Safe")).drop("_t", "_hit", "_m", "_s")


def positive(label: Column) -> Column:
    return F.upper(label).isin("MALICIOUS", "ATTACK")


def tokens(text: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    newer = "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in NEWER_LETTERS.split())
    cut = lambda more: F.split(upper(text), rf"[^\p{{L}}\p{{N}}_${more}]+")
    words = F.when(text.rlike(r"[^\x00-\x{86f}]"), cut(newer)).otherwise(cut(""))
    return F.array_distinct(F.filter(words, lambda t: F.char_length(t) >= 3))


def discover(samples: DataFrame, payload: str = "payload", label: str = "label", top: int = 40, least: int = 2, upper: Callable[[Column], Column] = F.upper) -> DataFrame:
    """word, mal, safe, score: words by how unevenly the classes' documents hold them."""
    one = samples.select(positive(F.col(label)).alias("m"), F.explode(tokens(F.col(payload), upper)).alias("word"))
    df = one.groupBy("word").agg(F.count_if("m").alias("mal"), F.count_if(~F.col("m")).alias("safe")).where(F.col("mal") + F.col("safe") >= least)
    return df.withColumn("score", F.abs(F.log((F.col("mal") + 1) / (F.col("safe") + 1)))).orderBy(F.desc(F.round("score", 9)), F.desc("word")).limit(top)


def train(samples: DataFrame, words: list[str], payload: str = "payload", label: str = "label", laplace: float = 1.0) -> DataFrame:
    """ord, word, p_mal, p_safe from document frequencies; the samples are read once for the class sizes and once for the counts. Words are upper-cased and sorted."""
    words = sorted({w.upper() for w in words})
    m, u = positive(F.col(label)), F.upper(F.coalesce(F.col(payload), F.lit("")))
    rows = samples.select(m.alias("m"), F.filter(F.lit(words), lambda w: F.contains(u, w)).alias("ws"))
    totals = rows.agg(F.count_if("m").alias("n_mal"), F.count_if(~F.col("m")).alias("n_safe"))
    n = totals.first()
    if not n["n_mal"] or not n["n_safe"]:
        raise ValueError("both classes are needed")
    counts = rows.select("m", F.explode("ws").alias("word")).groupBy("word").agg(F.count_if("m").alias("mal"), F.count_if(~F.col("m")).alias("safe"))
    all_ = samples.sparkSession.createDataFrame(list(enumerate(words)), "ord int, word string").join(counts, "word", "left").na.fill(0)
    p = lambda c, k: F.round((F.col(c) + laplace) / (n[k] + 2 * laplace), 6)
    return all_.select("ord", "word", p("mal", "n_mal").alias("p_mal"), p("safe", "n_safe").alias("p_safe"))


def prior(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.agg((F.count_if(positive(F.col(label))) / F.count("*")).alias("prior_malicious"))


def from_brain(spark: SparkSession, brain: dict) -> tuple[DataFrame, tuple[float, float]]:
    """Vocabulary and priors of a stored model. Keys in upper case, malformed pairs and chances of zero left out; the built-in words where none is valid."""
    rows = []
    stored = brain.get("likelihoods")
    for word, pair in (stored.items() if isinstance(stored, dict) else ()):
        try:
            rows.append((len(rows), word.upper(), float(pair[0]), float(pair[1])))
        except (TypeError, ValueError, IndexError, KeyError):
            continue
    rows = [r for r in rows if r[2] > 0 and r[3] > 0]
    priors = tuple(float(brain.get(k, p)) for k, p in zip(("prior_malicious", "prior_safe"), PRIORS))
    return spark.createDataFrame(rows, "ord int, word string, p_mal double, p_safe double") if rows else vocabulary(spark), priors


def to_json(vocab: DataFrame, priors: tuple[float, float]) -> str:
    return json.dumps({"prior_malicious": priors[0], "prior_safe": priors[1], "likelihoods": {w: [a, b] for w, a, b in as_rows(vocab)}})
