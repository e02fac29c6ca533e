"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Words become lower-case tokens; numbers in digits or words, units after numbers, and capitalised words become
typed placeholders that keep their value aside. Windows of ``words`` tokens are hashed and joined between
the documents and the benchmark; each text is tokenised once, whatever the lengths of the items. A document holds an item where at least ``coverage`` of the item's distinct
windows occur in it. A changed word costs up to five windows, but one token: pairs with two windows or more, near
the commonest distance and over a ``SEED`` of the item's tokens, are hits too where at least ``covered`` of its tokens lie
under such a window or agree along the alignment, by type or in value. For those pairs alone, tokens are aligned along the commonest distance between window
positions, and slot consistency is checked: each value of the item must stand for one value of the
document throughout. Same values everywhere is a verbatim leak, consistent other values a re-parameterised
one; inconsistent values are reported only where the plain words alone reach the coverage.

Defined results: null or empty texts match nothing; an item with fewer tokens than a window is matched by
one window of its own length, if it has ``least`` tokens or more, else never, as its words are in most documents; repeated
rows give one pair, and so do rows that share a doc_id; items with equal text each match; of equally common distances the
smallest is the alignment; texts of any length are read whole; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

WORDS = 5
COVERAGE = 0.6
#: Of an item's tokens, for a hit and to be looked at; windows may be so large a part of the item off their place, for words put in or left out.
COVERED = 0.75
SEED = 0.25
DRIFT = 0.2
#: Items shorter than a window need so many tokens.
LEAST = 3
#: Changed values alone say little about an item of fewer plain words.
PLAIN = 3
BROADCAST_BYTES = 8 << 20
# Units of measure and money.
UNITS = "km|m|cm|mm|mi|mile|miles|ft|feet|in|inch|inches|kg|g|mg|lb|lbs|oz|l|ml|s|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years|kmh|mph|usd|eur|gbp|dollar|dollars|euro|euros|cent|cents|percent|degrees|watt|watts|volt|volts"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
SIGNS = ("\u0001", "\u0002", "\u0003")
NUMBER = r"(?<![\p{L}\p{N}])\d+(?:[.,]\d+)*"


def tokens(text: Column) -> Column:
    """array<string>: words in lower case; placeholders are a type sign, then the value: 0=number, 1=unit, 2=name."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "[\u0000-\u0003]", " ")
    t = F.regexp_replace(t, rf"(?i)({NUMBER})\s*({UNITS})(?![\p{{L}}\p{{N}}])", " \u0001$1 \u0002$2 ")
    t = F.regexp_replace(t, rf"(?<!\u0001)(?<![\d.,]){NUMBER}(?![\p{{L}}\p{{N}}])", " \u0001$0 ")
    # a capital, at the start of a sentence too; several names in a row are several slots
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "\u0003$1")
    return F.filter(F.split(F.lower(t), "[^\\p{L}\\p{N}\u0001\u0002\u0003]+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """A token without its sign: signs sort below all letters and digits."""
    return F.when(word < "\u0004", F.substring(word, 2, 1 << 30)).otherwise(word)


def marked(words: Column) -> Column:
    """Number words, at the start of a sentence or not, with the sign of numbers."""
    return F.transform(words, lambda w: F.when(bare(w).isin(NUMBER_WORDS), F.concat(F.lit(SIGNS[0]), bare(w))).otherwise(w))


def typed(words: Column) -> Column:
    """Placeholders without their values."""
    names = [SIGNS[2] + w for w in NUMBER_WORDS]
    return F.transform(words, lambda w: F.when(w.isin(NUMBER_WORDS + names), SIGNS[0]).when(w < "\u0004", F.substring(w, 1, 1)).otherwise(w))


def windows(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """One row per window of ``toks`` of each length: h, pos (from 0), n."""
    size = F.size("toks")
    shifted = [F.slice("toks", i + 1, F.greatest(size - i, F.lit(0))) for i in range(max(lengths))]
    # the shorter arrays are filled with nulls: no window there
    df = df.select(*keep, F.posexplode(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])).alias("pos", "w"))
    hashed = [F.when(F.col("w")[f"w{n - 1}"].isNotNull(), F.xxhash64(F.lit(n), *[F.col("w")[f"w{i}"] for i in range(n)])) for n in lengths]
    if len(lengths) == 1:
        return df.select(*keep, "pos", F.lit(lengths[0]).alias("n"), hashed[0].alias("h")).where("h is not null")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), h.alias("h")) for n, h in zip(lengths, hashed)])).alias("e")
    return df.select(*keep, "pos", each).select(*keep, "pos", "e.n", "e.h").where("h is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, coverage: float = COVERAGE, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, coverage, start (token of the document where the item starts), slots, changed, consistent, kind."""
    items = benchmark.select("item_id", marked(tokens(F.col("text"))).alias("raw")).withColumn("toks", typed(F.col("raw"))).distinct()
    items = saved(items, "items")
    lengths = [r[0] for r in items.select(F.least(F.size("toks"), F.lit(words)).alias("n")).distinct().orderBy("n").collect() if least <= r[0] <= words]
    if not lengths:
        return with_slots(docs, items, docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, start int, under array<int>"), coverage, covered)
    # an item has windows of one length: its own where it is short
    own = windows(items, lengths, ["item_id", "toks"]).where(F.col("n") == F.least(F.size("toks"), F.lit(words))).drop("toks")
    own = saved(own, "item-windows")
    sized = own.groupBy("item_id").agg(F.countDistinct("h").alias("all"), (F.max("pos") + F.max("n")).alias("size"))
    first = own.groupBy("item_id", "h", "n").agg(F.min("pos").alias("item_pos"), F.collect_set("pos").alias("places")).join(sized, "item_id")
    first = saved(first, "item-keys")
    small = (first.agg(F.sum(F.size("places") * 4 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    grouped = first.groupBy("h").agg(F.collect_list(F.struct("item_id", "item_pos", "places", "all", "size", "n")).alias("of")) if small else first
    texts = windows(docs.select("doc_id", typed(tokens(F.col("text"))).alias("toks")), lengths, ["doc_id"]).drop("n")
    hits = texts.join(F.broadcast(grouped) if small else grouped, "h")
    if small:  # a window shared by many items meets one row
        hits = hits.select("doc_id", "pos", "h", F.inline("of"))
    # once per document, item and window first: repeats of a frequent window end here
    pair = ["doc_id", "item_id", "all", "size", "n"]
    hits = hits.groupBy(*pair, "h").agg(F.first("item_pos").alias("item_pos"), F.first("places").alias("places"), F.min("pos").alias("pos"))
    hits = hits.groupBy(*pair).agg(F.count("*").alias("got"), F.mode(F.col("pos") - F.col("item_pos"), True).alias("start"), F.collect_list(F.struct("pos", "item_pos", "places")).alias("at"))
    near = F.filter("at", lambda w: F.abs(w["pos"] - w["item_pos"] - F.col("start")) <= F.greatest(F.lit(2), F.col("size") * DRIFT))
    under = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(near, lambda w: w["places"])), lambda p: F.sequence(p, p + (F.col("n") - 1)))))
    found = hits.where("got > 1 or all = 1").withColumn("under", under)
    found = found.where((F.col("got") >= F.col("all") * coverage) | (F.size("under") >= F.col("size") * SEED))
    found = found.select("doc_id", "item_id", (F.col("got") / F.col("all")).alias("coverage"), "start", "under")
    return with_slots(docs, items, saved(found, "pairs"), coverage, covered)


def with_slots(docs: DataFrame, items: DataFrame, pairs: DataFrame, coverage: float = COVERAGE, covered: float = COVERED) -> DataFrame:
    """Compare the tokens of each pair, and its placeholders' values, along its alignment."""
    own = docs.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id").select("doc_id", marked(tokens(F.col("text"))).alias("doc_raw"))
    both = pairs.join(own, "doc_id").join(items.select("item_id", "raw", F.size("raw").alias("n")), "item_id")
    signs = SIGNS
    type_ = lambda w: F.when(F.substring(w, 1, 1).isin(*signs), F.substring(w, 1, 1)).otherwise(w)
    same = lambda w, v: F.coalesce((type_(w) == type_(v)) | (bare(w) == bare(v)), F.lit(False))
    agrees = F.filter("raw", lambda w, i: F.array_contains("under", i) | same(w, F.get("doc_raw", F.col("start") + i)))
    both = both.where((F.col("coverage") >= coverage) | (F.size(agrees) >= F.col("n") * covered))
    both = both.withColumn("at", F.greatest(F.col("start"), F.lit(0))).withColumn("skip", F.greatest(-F.col("start"), F.lit(0)))
    both = both.withColumn("theirs", F.slice("doc_raw", F.col("at") + 1, F.col("n") - F.col("skip"))).withColumn("ours", F.slice("raw", F.col("skip") + 1, F.col("n") - F.col("skip")))
    zipped = F.arrays_zip(F.col("ours").alias("a"), F.col("theirs").alias("b"))
    # a slot: both sides hold a placeholder of one type
    slots = F.filter(zipped, lambda p: F.substring(p["a"], 1, 1).isin(*signs) & (F.substring(p["a"], 1, 1) == F.substring(p["b"], 1, 1)))
    both = both.withColumn("slots", slots)
    maps = F.size(F.array_distinct("slots"))
    consistent = maps == F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    changed = F.size(F.filter("slots", lambda p: p["a"] != p["b"]))
    words = F.filter(zipped, lambda p: ~F.substring(p["a"], 1, 1).isin(*signs))
    plain = F.size(F.filter(words, lambda p: p["a"] == p["b"])) / F.greatest(F.size(words), F.lit(1))
    # of the item's plain words, those under a found window: holds where a word put in shifts the alignment
    beneath = F.size(F.filter("raw", lambda w, i: ~F.substring(w, 1, 1).isin(*signs) & F.array_contains("under", i))) / F.greatest(F.size(F.filter("raw", lambda w: ~F.substring(w, 1, 1).isin(*signs))), F.lit(1))
    plain = F.greatest(plain, beneath)
    out = both.select("doc_id", "item_id", "coverage", "start", F.size("slots").alias("slots"), changed.alias("changed"), consistent.alias("consistent"), plain.alias("plain"), F.size(words).alias("words"))
    kind = F.when(F.col("changed") == 0, "verbatim").when(F.col("consistent") & (F.col("words") >= PLAIN), "reparameterised").otherwise("similar")
    out = out.withColumn("kind", kind).where((F.col("kind") != "similar") | (F.col("plain") >= COVERAGE)).drop("plain", "words")
    rest = ["coverage", "start", "slots", "changed", "consistent", "kind"]  # rows that share a doc_id: the best covered
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("best")).select("doc_id", "item_id", "best.*")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
