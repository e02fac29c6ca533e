"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

An index holds runs: tables of (h1, h2, docs, keeper, fresh), bucketed and sorted by the 128-bit key hash. A new
batch is summed to one row per key and merge-anti-joined with the runs: keys that no run has are added as fresh, the
others as counts to add to a key of an older run. All runs have the same buckets, so neither these joins nor
the merging of runs moves or sorts a run again. When a level holds ``fanout`` runs they are merged into one of
the next level. A fresh row is the only one of its key; ``repeated`` adds to each the counts that newer runs
hold for it. Counts add up and the largest doc_id wins, so the order of batches does not matter.

Defined results: null or empty text is one empty line; rows that share a doc_id are one document when
documents are counted, and each keeps its own output row; rows without doc_id count as one document and lose
nothing; repeated lines of one document count once; ties cannot occur, as the largest doc_id is one; texts of
any length are split whole; an empty table gives no rows; other columns are ignored by the query and kept by
``dedup``, but for those named n_lines, n_dropped or kept, which it sets.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_dir, table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 3
FANOUT = 2
SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Keys with more than this share of all lines are joined by broadcast: there are 1 / HOT at most.
HOT = 1e-4


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() does just that where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, pos and the key's two hashes, for lines whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within, scans of bucketed tables of one file a bucket are taken for as sorted as they were written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class LineRuns:
    """The levels of an index; every run is a bucketed table (h1, h2, docs, keeper, fresh) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        """Oldest first."""
        return [r for level in reversed(self.levels) for r in level]

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"wiregaze_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{scratch_dir(self.spark)}/wiregaze/{name}").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # of the catalog alone: the files stay
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch's lines (doc_id, h1, h2). Returns its keys that no earlier batch had."""
        own = lines.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        with sorted_scans(self.spark):
            old = self.runs()
            for i, r in enumerate(old):
                own = own.join(r.select(*KEY, F.lit(True).alias(f"seen{i}")).hint("merge"), KEY, "left")
            fresh = ~F.coalesce(*[F.col(f"seen{i}") for i in range(len(old))], F.lit(False))
            run = self._write(own.select(*KEY, "docs", "keeper", fresh.alias("fresh")))
            self._put(run, 0)
        return run.where("fresh").select(*KEY)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(reduce(self._merge, self.levels[level]))
            self.levels[level] = []
            self._put(merged, level + 1)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """One run of two: each holds a key once."""
        b = b.select(*KEY, *[F.col(c).alias(f"{c}_b") for c in ("docs", "keeper", "fresh")])
        both = a.join(b.hint("merge"), KEY, "full")
        none = F.lit(0).cast("long")
        return both.select(
            *KEY, (F.coalesce("docs", none) + F.coalesce("docs_b", none)).alias("docs"), F.greatest("keeper", "keeper_b").alias("keeper"),
            (F.coalesce("fresh", F.lit(False)) | F.coalesce("fresh_b", F.lit(False))).alias("fresh"),
        )

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys found in at least min_docs documents: docs, and keeper, the largest doc_id that holds them."""
        old, parts = self.runs(), []
        with sorted_scans(self.spark):
            for i, run in enumerate(old):
                own = run.where("fresh").drop("fresh")
                for more in old[i + 1 :]:
                    more = more.where("not fresh").select(*KEY, F.col("docs").alias("d"), F.col("keeper").alias("k"))
                    own = own.join(more.hint("merge"), KEY, "left")
                    own = own.select(*KEY, (F.col("docs") + F.coalesce("d", F.lit(0).cast("long"))).alias("docs"), F.greatest("keeper", "k").alias("keeper"))
                parts.append(own.where(F.col("docs") >= min_docs))
            return saved(reduce(DataFrame.unionByName, parts), "repeated")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with n_lines, n_dropped and kept (the text left), beside their own columns."""
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return dedup_rows(docs, min_chars, min_docs, batches, fanout).select(*own, "n_lines", "n_dropped", "kept")


def dedup_rows(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """row (a document's columns as one), n_lines, n_dropped, kept."""
    lines = keyed_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    lines = saved(lines, "lines")
    index = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b))
    repeated = index.repeated(min_docs)
    # a key's documents are at most its lines: more than HOT of all lines have 1 / HOT keys at most, 40 bytes each
    hot = F.col("docs") > max(1, int(lines.count() * HOT))
    common = F.broadcast(repeated.where(hot))
    gone = lines.join(common, KEY).unionByName(lines.join(common, KEY, "left_anti").join(repeated.where(~hot).hint("merge"), KEY))
    gone = gone.where("doc_id <> keeper").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # the input's row is one column, so that its names and those used here never meet
    all_ = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")).join(gone, ["doc_id", "text_hash"], "left")
    all_ = all_.select("row", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), split_lines(F.col("row.text")).alias("lines"))
    n = F.size("lines")
    # kept lines lie between neighbouring dropped ones: whole slices, linear in the text
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(n))
    between = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.col("ends")[i - 1] + 2, F.col("ends")[i] - F.col("ends")[i - 1] - 1))
    kept = F.when(F.size("gone") == 0, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.flatten(between), "\n"))
    return all_.withColumn("ends", ends).select("row", n.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), dup AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(k.doc_id <> dup.keeper, false) AS gone FROM k LEFT JOIN dup USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
