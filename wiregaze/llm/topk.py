"""Exact top-k by Hamming distance: incremental multi-index hashing (Norouzi et al., 2012).

A code of 64 bits is cut into segments of 8 to 16 bits, so wide that a value has some hundred codes; the index holds every
distinct code under each (segment, value). Round r probes, for each open query, all values at exactly r bits from its own in
every segment; queries that probe one value meet its codes together, in blocks, and the candidates' whole distances are
verified: a pair only at its nearest segment, the first of equal ones, so once. After round r all codes within segments * (r + 1) - 1 bits have
been seen, so a query closes once its kth neighbour is that near; the rest go on. Copies share one index
entry with their k smallest ids, which is all that a top-k can use; a crowded bucket is split into blocks.

Defined results: distances tie by id; the query row is one of all rows; null ids, and null embeddings or ones of another
length, are neither queries nor rows; a null component counts as not above zero; fewer rows than k give that many; repeated rows (one id) count once;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, saved, table

K = 10
BITS = 64
BLOCK = 1024
#: Codes of a value, by which the segments' width is chosen; queries that meet a block at once, about.
BUCKET_BITS = 8
TOGETHER = 512
#: Queries whose nearest a task keeps before it hands them on.
HELD = 1 << 14
EVERY = 50


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is 1 where component i is above zero; null unless there are ``bits`` components."""
    ones = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(bits)]
    return F.when(F.size(vector) == bits, reduce(lambda a, b: a.bitwiseOR(b), ones))


def cuts(codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = -(-BITS // min(16, max(8, round(math.log2(max(2, codes))) - BUCKET_BITS)))
    ends = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def segments(code: Column, at: list[tuple[int, int]]) -> Column:
    """One struct (seg, value) a segment."""
    return F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << w) - 1)).cast("int").alias("value")) for s, (a, w) in enumerate(at)])


def masks(width: int, r: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(width), r)]


def search(rows: DataFrame, queries: DataFrame, k: int = K, held: int = HELD, at: list[tuple[int, int]] | None = None) -> DataFrame:
    """rows, queries: id, code (long). -> query_id, rank, neighbor_id, distance."""
    codes = rows.select("id", "code").distinct().groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    codes = saved(codes.withColumn("n", F.least("n", F.lit(k)).cast("int")), "codes")
    total = codes.count()
    at = at or cuts(total)
    width = max(w for _, w in at)
    by = codes.select("code", "first", "n", F.explode(segments(F.col("code"), at)).alias("e")).select("e.seg", "e.value", "code", "first", "n")
    # a row for each of the 2^16 values of four segments at most: a bound that no input passes
    crowded = F.broadcast(saved(by.groupBy("seg", "value").count().where(F.col("count") > BLOCK), "crowded").withColumnRenamed("count", "size"))
    by = by.join(crowded, ["seg", "value"], "left").withColumn("block", F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("code"), F.ceil(F.col("size") / BLOCK))))
    index = saved(by.groupBy("seg", "value", "block").agg(F.collect_list("code").alias("codes"), F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns")), "index")
    asked = saved(queries.select("id", "code").distinct(), "asked")
    best_type = "array<struct<d:int,first:long,code:long,n:int>>"
    states = Rounds(rows.sparkSession, "state")
    state = states.put(asked.select(F.col("code").alias("q")).distinct().withColumn("best", F.array().cast(best_type)).withColumn("open", F.lit(True)))

    kind = pa.list_(pa.struct([("d", pa.int32()), ("first", pa.int64()), ("code", pa.int64()), ("n", pa.int32())]))
    parts = [(np.uint64(a), np.uint64((1 << w) - 1)) for a, w in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set] = {}
        worst: dict[int, int] = {}  # distance of the kth found

        def trim(q: int) -> None:
            best = sorted(found[q])[:k]
            found[q] = set(best)
            if len(best) == k:
                worst[q] = best[-1][0]

        def out() -> pa.RecordBatch:
            for q in found:
                trim(q)
            rows_ = [[dict(zip(("d", "first", "code", "n"), x)) for x in sorted(v)] for v in found.values()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(rows_, kind)], ["q", "best"])
            found.clear()
            worst.clear()
            return batch

        for b in batches:
            for qs, s, *cols in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                qs = qs.values.to_numpy()
                c, f, n = (x.values.to_numpy() for x in cols)
                for start in range(0, len(qs), TOGETHER):
                    some = qs[start : start + TOGETHER]
                    x = (some[:, None] ^ c[None, :]).view(np.uint64)  # of signed values numpy counts the magnitude's bits
                    apart = np.stack([np.bitwise_count((x >> a) & m) for a, m in parts])
                    # at the first of the nearest segments; elsewhere further than any code
                    d = np.where(apart.argmin(axis=0) == s, apart.sum(axis=0, dtype=np.uint8), 255)
                    for q, own in zip(some.tolist(), d):
                        near = np.nonzero(own <= worst.get(q, BITS))[0]
                        if not len(near):
                            continue
                        if len(near) > k:
                            near = near[np.lexsort((f[near], own[near]))[:k]]
                        held_ = found.setdefault(q, set())
                        held_.update(zip(own[near].tolist(), f[near].tolist(), c[near].tolist(), n[near].tolist()))
                        if len(held_) >= 2 * k:
                            trim(q)
                if len(found) >= held:
                    yield out()
        if found:
            yield out()

    salts = max(1, -(-asked.count() // TOGETHER))
    for r in range(width + 1):
        todo = state.where("open")
        if todo.isEmpty():
            break
        probes = todo.select("q", F.explode(segments(F.col("q"), at)).alias("e"))
        # a value with a bit beyond a shorter segment is in no bucket
        probes = probes.select("q", "e.seg", F.explode(F.transform(F.lit(masks(width, r)), lambda m: F.col("e.value").bitwiseXOR(m))).alias("value"))
        probes = probes.groupBy("seg", "value", F.pmod(F.xxhash64("q"), F.lit(salts)).alias("salt")).agg(F.collect_list("q").alias("qs"))
        # the planner takes the exploded probes for as small as their source and would broadcast them
        new = probes.join(index.hint("merge"), ["seg", "value"]).select("qs", "seg", "codes", "firsts", "ns").mapInArrow(run, f"q long, best {best_type}")
        merged = todo.select("q", "best").union(new).groupBy("q").agg(F.flatten(F.collect_list("best")).alias("best"))
        merged = merged.withColumn("best", F.slice(F.array_sort(F.array_distinct("best")), 1, k))
        bound = len(at) * (r + 1) - 1
        have = F.aggregate(F.filter("best", lambda x: x["d"] <= bound), F.lit(0), lambda a, x: a + x["n"])
        closed = (have >= k) | (F.size("best") >= total) | F.lit(r == width)
        state = states.put(state.where("not open").union(merged.withColumn("open", ~closed)))
    ids = rows.select("id", "code").distinct().join(state.select(F.explode("best.code").alias("code")).distinct(), "code", "left_semi")
    w = smallest(ids, k)
    hits = state.select("q", F.explode("best").alias("b")).select("q", "b.d", "b.code").join(w, "code").select("q", "d", F.explode("ids").alias("neighbor_id"))
    top = hits.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbor_id"))), 1, k).alias("top"))
    out = asked.join(top, F.col("code") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode("top").alias("rank", "t"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.neighbor_id", F.col("t.d").cast("int").alias("distance"))


def smallest(ids: DataFrame, k: int) -> DataFrame:
    """code -> its k smallest ids; first within 64 salts of a code, so that no copy group meets in one task."""
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = salted.groupBy("code", "salt").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))
    return w.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")).where("code is not null and id is not null")
    rows = saved(rows, "signs")
    return search(rows, rows.where(F.col("id") % EVERY == 0))


OP8_SQL = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x > 0)::INT) AS s FROM embeddings WHERE len(embedding) = 64),
d AS (
  SELECT q.id AS query_id, r.id AS neighbor_id,
         list_sum(list_transform(list_zip(q.s, r.s), lambda p: (p[1] <> p[2])::INT))::INT AS distance
  FROM e q, e r WHERE q.id % 50 = 0
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= 10
"""
