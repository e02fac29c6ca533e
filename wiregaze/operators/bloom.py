"""Reputation filter: a Bloom filter with the fixed hash family, as arrays of positions and as hex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bloom_positions, strip

SIZE, HASHES = 1000, 3


def build(items: DataFrame, item: str, size: int = SIZE, hashes: int = HASHES) -> DataFrame:
    """One row: bits (sorted positions set, at most ``size``), items_added (duplicates too)."""
    df = items.select(F.col(item).alias("i")).where("i is not null")
    bits = df.select(F.explode(bloom_positions(F.col("i"), size, hashes)).alias("p")).agg(F.array_sort(F.collect_set("p")).alias("bits"))
    return bits.crossJoin(F.broadcast(df.agg(F.count("*").alias("items_added"))))  # one row each


def safe_label(label: Column) -> Column:
    return F.lower(strip(label)).isin("normal", "safe", "benign", "0")


def train(rows: DataFrame, item: str = "ip", label: str = "label", size: int = SIZE, hashes: int = HASHES) -> DataFrame:
    return build(rows.where(~safe_label(F.col(label))), item, size, hashes)


def bits_of(filter_: DataFrame) -> list[int]:
    return list(filter_.select("bits").first()[0] or [])


def check(df: DataFrame, item: str, bits: list[int], size: int = SIZE, hashes: int = HASHES) -> Column:
    """True where all positions are set. Bits are at most ``size`` literals."""
    known = F.lit(bits) if bits else F.array().cast("array<int>")
    return F.coalesce(F.forall(bloom_positions(F.col(item), size, hashes), lambda p: F.array_contains(known, p)), F.lit(False))


def saturation(bits: Column, size: int = SIZE) -> Column:
    return F.size(bits) / F.lit(size)


def false_positive_rate(bits: Column, size: int = SIZE, hashes: int = HASHES) -> Column:
    return F.pow(saturation(bits, size), F.lit(hashes))


def verdict(hit: Column, fp: float) -> Column:
    return F.struct(F.when(hit, "Blacklisted").otherwise("Unknown").alias("label"), F.when(hit, 1.0 - fp).otherwise(0.0).alias("confidence"))


def to_hex(bits: list[int], size: int = SIZE) -> str:
    n = (size + 7) // 8
    raw = bytearray(n)
    for b in bits:
        raw[b // 8] |= 0x80 >> b % 8
    return bytes(raw).hex()


def from_hex(digits: str, size: int = SIZE) -> list[int] | None:
    try:
        raw = bytes.fromhex(digits)
    except ValueError:
        return None
    return [i for i in range(min(size, 8 * len(raw))) if raw[i // 8] >> (7 - i % 8) & 1]


def unlisted(df: DataFrame, item: str, listed: DataFrame, listed_item: str) -> DataFrame:
    """Rows whose item is not listed."""
    return df.join(listed.select(F.col(listed_item).alias(item)).distinct(), item, "left_anti")


def exact(df: DataFrame, item: str, listed: DataFrame, listed_item: str) -> DataFrame:
    """Rows whose item is listed. Spark broadcasts the list where it is small."""
    return df.join(listed.select(F.col(listed_item).alias(item)).distinct(), item, "left_semi")
