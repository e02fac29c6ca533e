"""Values that depend on a whole order, in two levels: one row a block is put in order, then each block by itself.

No task sees more than the rows of one block, or one row of each block; nulls among the ``by`` columns are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def numbered(order: str, size: int = BLOCK) -> Column:
    """The block of a number, such as a row number or a second."""
    return F.floor(F.col(order).cast("double") / size)


def _joined(df: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in blocks.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(blocks, same).drop(*[f"_k{i}" for i in range(len(keys))])


def rank(df: DataFrame, order: str, out: str, by: tuple[str, ...] = (), block: Column | None = None, total: str | None = None) -> DataFrame:
    """Adds the row's place, from 0, within its group; ``total`` names a column for the group's size."""
    df = df.withColumn("_block", numbered(order) if block is None else block)
    keys = [*by, "_block"]
    blocks = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        blocks = blocks.withColumn(total, F.sum("_rows").over(Window.partitionBy(*by)))
    df = _joined(df, blocks.drop("_rows"), keys)
    return df.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).drop("_block", "_before")


def hash_rank(df: DataFrame, digest: str, out: str, by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """``rank`` by a column of hex digests, whose first digits are the blocks."""
    return rank(df, digest, out, by, F.substring(digest, 1, 4), total)


def running(df: DataFrame, order: str, values: dict[str, Column], how: str = "sum", size: int = BLOCK) -> DataFrame:
    """Adds running sums (or, how="max", maxima) of the values up to and with the row."""
    f = {"sum": F.sum, "max": F.max}[how]
    df = df.withColumns({"_block": numbered(order, size)} | {f"_v_{n}": v for n, v in values.items()})
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = df.groupBy("_block").agg(*[f(f"_v_{n}").alias(f"_b_{n}") for n in values])
    blocks = blocks.select("_block", *[f(f"_b_{n}").over(before).alias(f"_b_{n}") for n in values])
    own = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = _joined(df, blocks, ["_block"])
    zero = F.lit(0)
    add = (lambda n: F.coalesce(f"_b_{n}", zero) + F.coalesce(F.sum(f"_v_{n}").over(own), zero)) if how == "sum" else (lambda n: F.greatest(F.col(f"_b_{n}"), F.max(f"_v_{n}").over(own)))
    return df.withColumns({n: add(n) for n in values}).drop("_block", *[f"_{k}_{n}" for k in "bv" for n in values])


def with_context(df: DataFrame, place: str, context: int, size: int = BLOCK) -> tuple[DataFrame, str, str]:
    """Rows dealt into blocks by their place, each block led by the ``context`` rows before it. Also the names of the block and of the flag of its own rows."""
    own = F.floor(F.col(place) / size)
    blocks = F.when(F.col(place) % size >= size - context, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_at", F.explode(blocks)).withColumn("_own", F.col("_at") == own), "_at", "_own"
