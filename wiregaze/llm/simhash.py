"""SimHash near-duplicates by tiled exact comparison.

Every text becomes a 64-bit fingerprint. Equal fingerprints are grouped first, so exact copies cost one
row. The distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters
(a cell), large cells into several tiles by a hash. Two fingerprints within ``radius`` bits have quarter
counts that differ by ``radius`` in sum at most, so a tile only visits tiles of cells that near; the rest
is skipped. A pair of tiles is compared whole, by numpy exclusive-or and bit counts. Each task sends on a
spanning forest of the links that it found, never all pairs, and components follow from alternating stars.

``near_duplicates`` takes three-word shingles and three bits of 64; ``similar_groups`` finds a Jaccard
similarity of five-word shingle sets by the same comparison of 1024 bits.

Defined results: null, empty or wordless text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; repeated rows stay, with the same values; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, saved, table

WORDS = 3
RADIUS = 3
SEED = 42
#: Shingles whose bits are counted at once; bounds memory for long texts.
BLOCK = 1 << 14
#: Of similar_groups: words of a shingle, least similarity, bits, words of the first comparison, rows compared at once.
WIDE_WORDS = 5
SIMILARITY = 0.8
WIDE_BITS = 1024
HEAD = 2
STRIP = 256
#: Shingles of the texts that are verified together, but for one pair: 32 MB.
HASHES = 1 << 22
#: Standard deviations about the similarity within which pairs are verified; partners of a row in a crowded strip.
MARGIN = 3
NEAREST = 4
#: Sets of so many shingles at most have limits by their sizes, so many standard deviations about the exact chances.
FEW = 64
FEW_MARGIN = 6
BROADCAST_BYTES = 8 << 20
# The increments and multipliers of the splitmix64 generator.
STEPS = np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
QUARTERS = tuple(0xFFFF << s for s in (0, 16, 32, 48))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(join(w[i : i + words]), SEED) for i in range(at, min(n, at + BLOCK))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over 64-bit ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        """Whether the link joined two trees."""
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def links(self) -> tuple[list[int], list[int]]:
        a = [x for x in self.up if self.root(x) != x]
        return a, [self.root(x) for x in a]


def spanning(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of the links near[i, j], enough to join all that they join: all of few, else a breadth-first forest."""
    if near.sum() <= 4 * sum(near.shape):
        yield from zip(*(x.tolist() for x in np.nonzero(near)))
        return
    rows, cols = near.any(axis=1), np.ones(near.shape[1], bool)  # not yet reached
    for start in np.nonzero(rows)[0]:
        if not rows[start]:
            continue
        rows[start] = False
        front = np.array([start])
        while len(front):
            new = np.nonzero(near[front].any(axis=0) & cols)[0]
            cols[new] = False
            yield from zip(front[near[np.ix_(front, new)].argmax(axis=0)].tolist() if len(new) else (), new.tolist())
            front = np.nonzero(near[:, new].any(axis=1) & rows)[0]
            rows[front] = False
            yield from zip(front.tolist(), new[near[np.ix_(front, new)].argmax(axis=1)].tolist() if len(front) else ())


def compare(a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Link fingerprints of a and b within radius, STRIP rows at a time."""
    for at in range(0, len(a), STRIP):
        part = a[at : at + STRIP]
        near = np.bitwise_count(part[:, None] ^ b[None, :]) <= radius
        if near.any():
            own, other = part.view(np.int64), b.view(np.int64)
            for i, j in spanning(near):
                forest.link(int(own[i]), int(other[j]))


def bit_differs(a: int, b: int, common: int) -> float:
    """The chance that a bit of the fingerprints of sets of a and b shingles differs: strict majorities of fair bits."""

    def pmf(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) for i in range(n + 1)], float) / 2.0**n

    def up(n: int) -> np.ndarray:
        tail = np.append(np.cumsum(pmf(n - common)[::-1])[::-1], 0)  # of i or more of the others
        return tail[np.clip(n // 2 + 1 - np.arange(common + 1), 0, n - common + 1)]

    p, q = up(a), up(b)
    return float(pmf(common) @ (p * (1 - q) + q * (1 - p)))


class Limits:
    """sure, radius and first bits of ``compare_wide``: those given, or of pairs with a set of FEW shingles or fewer, by both sizes."""

    def __init__(self, similarity: float, sure: int, radius: int, first: int):
        self.given = (sure, radius, first)
        top = int(FEW / similarity) + 1
        # sizes that cannot reach the similarity have a radius below zero
        self.few = np.full((3, top + 1, top + 1), -1, np.int16)
        for a in range(1, FEW + 1):
            for b in range(a, min(top, int(a / similarity + 1e-9)) + 1):
                least = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
                if least > a:
                    continue
                # parity makes the chances uneven in the common shingles, over a few of them only
                like = max(bit_differs(a, b, k) for k in range(least, min(a, least + 4) + 1))
                unlike = min(bit_differs(a, b, k) for k in range(max(0, least - 4), least))
                spread = lambda p: math.sqrt(p * (1 - p))
                far = min(WIDE_BITS, int(WIDE_BITS * like + FEW_MARGIN * math.sqrt(WIDE_BITS) * spread(like)))
                near = int(WIDE_BITS * unlike - FEW_MARGIN * math.sqrt(WIDE_BITS) * spread(unlike))
                bits = 64 * HEAD
                head = min(bits, int(bits * like + FEW_MARGIN * math.sqrt(bits) * spread(like)))
                self.few[:, a, b] = self.few[:, b, a] = max(-1, min(near, far)), far, head
        self.top, self.widest = top, max(radius, int(self.few[1].max()))

    def heads(self, apart: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of sizes n and m whose first words differ in few enough bits."""
        if not apart.size or min(n.min(), m.min()) > FEW:
            return np.nonzero(apart <= self.given[2])
        i, j = np.nonzero(apart <= max(self.given[2], int(self.few[2].max())))
        keep = apart[i, j] <= self.of(2, n[i], m[j])
        return i[keep], j[keep]

    def of(self, which: int, n: np.ndarray, m: np.ndarray) -> np.ndarray | int:
        """Limit ``which`` of each pair of sizes."""
        if not n.size or not m.size or min(n.min(), m.min()) > FEW:
            return self.given[which]
        small = self.few[which][np.minimum(n, self.top), np.minimum(m, self.top)]
        return np.where(np.minimum(n, m) > FEW, self.given[which], np.where(np.maximum(n, m) > self.top, -1, small)).astype(np.int16)


@lru_cache(maxsize=4)
def limits(similarity: float) -> Limits:
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = math.sqrt(share * (1 - share))
    margin = MARGIN * math.sqrt(WIDE_BITS) * spread
    sure, radius = int(WIDE_BITS * share - margin), int(WIDE_BITS * share + margin)
    bits = 64 * HEAD
    return Limits(similarity, sure, radius, int(bits * radius / WIDE_BITS + 4.5 * math.sqrt(bits) * spread))


def compare_wide(a: np.ndarray, b: np.ndarray, lim: Limits, forest: Forest) -> Iterator[np.ndarray]:
    """Rows are a node, its size and its fingerprint's words. All bits are compared where the first HEAD words differ in at most ``first``.

    Gives links to be verified as rows (node, node, size, size, sure): those of ``sure`` bits or fewer that the forest
    lacks, and those up to ``radius``: all of a strip, or where those outnumber its rows, the NEAREST of each row. A
    crowded strip also gives each of its nodes with itself; ``crowded_links`` compares those again.
    """
    ids, m = b[:, 0].view(np.int64), b[:, 1].view(np.int64)
    for at in range(0, len(a), STRIP):
        part = a[at : at + STRIP]
        own, n = part[:, 0].view(np.int64), part[:, 1].view(np.int64)
        apart = np.zeros((len(part), len(b)), np.uint8)
        for k in range(2, HEAD + 2):
            apart += np.bitwise_count(part[:, k, None] ^ b[None, :, k])
        i, j = lim.heads(apart, n, m)
        if not len(i):
            continue
        bits = np.concatenate([np.bitwise_count(part[i[k : k + BLOCK], 2:] ^ b[j[k : k + BLOCK], 2:]).sum(axis=1, dtype=np.int16) for k in range(0, len(i), BLOCK)])
        sure, radius = lim.of(0, n[i], m[j]), lim.of(1, n[i], m[j])

        def rows(i: np.ndarray, j: np.ndarray, flag: int) -> np.ndarray:
            return np.stack([own[i], ids[j], n[i], m[j], np.full(len(i), flag)], axis=1)

        near = np.zeros(apart.shape, bool)
        near[i[bits <= sure], j[bits <= sure]] = True
        joined = [(x, y) for x, y in spanning(near) if forest.link(int(own[x]), int(ids[y]))]
        if joined:
            yield rows(*np.array(joined).T, 1)
        open_ = (bits > sure) & (bits <= radius)
        i, j, bits = i[open_], j[open_], bits[open_]
        if len(i) > 4 * (len(part) + len(b)):
            keep = np.zeros(len(i), bool)
            for side in (i, j):
                order = np.lexsort((bits, side))
                ranks = np.arange(len(order)) - np.searchsorted(side[order], side[order])
                keep[order[ranks < NEAREST]] = True
            crowd = np.unique(np.concatenate([own[np.unique(i)], ids[np.unique(j)]]))
            none = np.zeros_like(crowd)
            yield np.stack([crowd, crowd, none, none, none], axis=1)
            i, j = i[keep], j[keep]
        if len(i):
            yield rows(i, j, 0)


def pair_blocks(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of nodes of sizes n and m as blocks (nodes, places, places) of at most HASHES shingles, or one pair."""
    order = np.lexsort((b, a))
    places: dict[int, int] = {}
    x: list[int] = []
    y: list[int] = []
    total = 0
    for p, q, u, v in zip(*(c[order].tolist() for c in (a, b, n, m))):
        more = (p not in places) * u + (q not in places) * v
        if x and (total + more > HASHES or len(places) > 2 * STRIP):
            yield np.array(list(places), np.int64), np.array(x, np.int32), np.array(y, np.int32)
            places, x, y, total, more = {}, [], [], 0, u + v
        total += more
        x.append(places.setdefault(p, len(places)))
        y.append(places.setdefault(q, len(places)))
    if x:
        yield np.array(list(places), np.int64), np.array(x, np.int32), np.array(y, np.int32)


def apart_blocks(a: np.ndarray, b: np.ndarray, lim: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows are a node, its size, its fingerprint's words and its group. Blocks of all pairs within the radius whose groups differ."""
    for at in range(0, len(a), STRIP):
        part = a[at : at + STRIP]
        n = part[:, 1].view(np.int64)
        for to in range(0, len(b), STRIP):
            other = b[to : to + STRIP]
            m = other[:, 1].view(np.int64)
            apart = np.zeros((len(part), len(other)), np.uint8)
            for k in range(2, HEAD + 2):
                apart += np.bitwise_count(part[:, k, None] ^ other[None, :, k])
            i, j = lim.heads(apart, n, m)
            split = part[i, -1] != other[j, -1]
            i, j = i[split], j[split]
            if not len(i):
                continue
            bits = np.concatenate([np.bitwise_count(part[i[k : k + BLOCK], 2:-1] ^ other[j[k : k + BLOCK], 2:-1]).sum(axis=1, dtype=np.int16) for k in range(0, len(i), BLOCK)])
            near = bits <= lim.of(1, n[i], m[j])
            i, j = i[near], j[near]
            yield from pair_blocks(part[i, 0].view(np.int64), other[j, 0].view(np.int64), n[i], m[j])


def tile_pairs(rows: DataFrame, coords: list[str], base: int, key: str, members: Column, deltas: list[tuple[int, ...]], share: int, most: int, tile: int | None = None) -> DataFrame:
    """Pairs of tiles (guests, fps) that are to be compared.

    ``coords`` are integers from 0 to base - 1 that name a row's cell; a large cell is several tiles by a
    hash of ``key``. A tile meets the tiles of cells that lie one of ``deltas`` away. ``members`` collects
    a tile. A tile has a ``share``-th of the rows, ``most`` at most; this is a matter of speed only.
    """
    cell = F.lit(0)
    for c in coords:
        cell = cell * base + F.col(c)
    celled = rows.withColumn("cell", cell)
    counts = saved(celled.groupBy("cell").count(), "cells")
    if tile is None:
        tile = min(most, max(256, (counts.agg(F.sum("count")).first()[0] or 0) // share))
    # one row for each of base^coords possible cells at most (83521 or 16384): a bound that no input passes
    sizes = F.broadcast(counts.select("cell", F.ceil(F.col("count") / tile).cast("int").alias("subs")))
    tiles = celled.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64(key), F.col("subs")).cast("int"))
    tiles = saved(tiles.groupBy("cell", "sub").agg(*[F.first(c).alias(c) for c in coords], members.alias("fps")), "tiles")
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in deltas])
    inside, home = F.lit(True), F.lit(0)
    for i, c in enumerate(coords):
        inside = inside & (F.col(c) + F.col("d")[i]).between(0, base - 1)
        home = home * base + F.col(c) + F.col("d")[i]
    visits = tiles.withColumn("d", F.explode(steps)).where(inside)
    visits = visits.select(home.alias("home"), F.col("cell").alias("guest"), F.col("sub").alias("guest_sub"), "fps").join(sizes.withColumnRenamed("cell", "home"), "home")
    visits = visits.withColumn("home_sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where("home <> guest or guest_sub <= home_sub")
    visits = visits.select("home", "home_sub", F.col("fps").alias("guests"))
    # merge: the planner takes the exploded visits for as small as the tiles and might broadcast them
    pairs = visits.join(tiles.select(F.col("cell").alias("home"), F.col("sub").alias("home_sub"), "fps").hint("merge"), ["home", "home_sub"])
    return pairs.select("guests", "fps")


def forest_links(pairs: DataFrame, radius: int) -> DataFrame:
    """Compare each pair of tiles of fingerprints; every task gives a spanning forest of its links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for g, h in zip(batch.column(0), batch.column(1)):
                compare(g.values.to_numpy().view(np.uint64), h.values.to_numpy().view(np.uint64), radius, forest)
        a, b = forest.links()
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in (a, b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def wide_links(pairs: DataFrame, lim: Limits) -> DataFrame:
    """Compare each pair of tiles of wide fingerprints: links (a, b, n, m, sure) to be verified.

    Sure ones are a spanning forest of the task's; others follow unless that forest joins them; those of a node with itself always do.
    """
    width = 2 + WIDE_BITS // 64
    names = ["a", "b", "n", "m", "sure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, found = Forest(), [np.zeros((0, 5), np.int64)]
        for batch in batches:
            for g, h in zip(batch.column(0), batch.column(1)):
                found.extend(compare_wide(*(t.values.to_numpy().view(np.uint64).reshape(-1, width) for t in (g, h)), lim, forest))
        rows = np.unique(np.concatenate(found), axis=0)
        trees = {x: forest.root(x) for x in list(forest.up)}
        rows = rows[np.array([s == 1 or x == y or trees.get(x, x) != trees.get(y, y) for x, y, _, _, s in rows.tolist()], bool)]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)].T
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in part[:4]], pa.array(part[4] == 1)], names)
        pa.default_memory_pool().release_unused()

    return pairs.mapInArrow(run, "a long, b long, n long, m long, sure boolean")


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (a, b) whose components are those of all pairs within radius."""
    q = [F.bit_count(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).cast("int") for m in QUARTERS]
    deltas = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    rows = fps.select("fp", *[c.alias(f"q{i}") for i, c in enumerate(q)])
    pairs = tile_pairs(rows, ["q0", "q1", "q2", "q3"], 17, "fp", F.collect_list("fp"), deltas, 400, 1 << 17, tile)
    return forest_links(pairs, radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints within ``radius`` bits."""
    marked = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(near_links(fps.select("fp"), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # saved, so that the planner may split a group that many rows are in
    least = saved(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    map_ = saved(named.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(map_, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the text's distinct word shingles; none without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))] if w else [], np.uint64))


def wide_fingerprint(text: str | None, words: int) -> tuple[int, np.ndarray]:
    """The number of distinct word shingles, and their SimHash of WIDE_BITS bits as unsigned 64-bit words."""
    h = shingle_set(text, words)
    counts = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(h), 255):  # sums of 255 bits fit a byte
        x = h[at : at + 255, None] + STEPS
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return len(h), np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def row_key() -> Column:
    """One key for rows of like doc_id and text; rows that share a doc_id alone have others."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def wide_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (its key), n (distinct shingles), pop (bits set) and fp (array of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(t.as_py(), words) for t in b.column(2)]
            n = pa.array([n for n, _ in found], pa.int64())
            pop = pa.array([int(np.bitwise_count(fp).sum()) for _, fp in found], pa.int32())
            fp = pa.array([fp.view(np.int64) for _, fp in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pop, fp], ["doc_id", "row", "n", "pop", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row long, n long, pop int, fp array<long>")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have the similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and common >= similarity * (len(x) + len(y) - common)


def shingles_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """nodes: node, row. -> node, hashes: the sorted shingle hashes of each node's text."""
    nodes = saved(nodes.distinct(), "ends")
    small = nodes.count() * 16 <= BROADCAST_BYTES
    texts = docs.select(row_key().alias("row"), F.col("text").cast("string")).join(F.broadcast(nodes) if small else nodes, "row")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))  # once of repeated rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["node", "hashes"])

    return saved(texts.mapInArrow(run, "node long, hashes array<long>"), "shingles")


BLOCK_SCHEMA = "nodes array<long>, x array<int>, y array<int>"


def block_batch(block: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(block, (pa.int64(), pa.int32(), pa.int32()))], ["nodes", "x", "y"])


def decided(blocks: DataFrame, hashes: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """The pairs (a, b) of each block that have the similarity; with forest, only those that join two trees of the block.

    A node's hashes go to each of its blocks once, so a node of many pairs costs as many rows as it has blocks.
    """
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    members = blocks.select("block", "x", "y", F.posexplode("nodes").alias("place", "node"))
    # the pairs of a block go with its first node only
    members = members.select("block", "place", "node", *[F.when(F.col("place") == 0, F.col(c)).alias(c) for c in ("x", "y")])

    def decide(group: pa.Table) -> pa.Table:
        places = group["place"].to_pylist()
        own = {p: h.values.to_numpy().view(np.uint64) for p, h in zip(places, group["hashes"])}
        nodes = dict(zip(places, group["node"].to_pylist()))
        x, y = next((p, q) for p, q in zip(group["x"].to_pylist(), group["y"].to_pylist()) if p is not None)
        trees, found = Forest(), []
        for i, j in zip(x, y):
            a, b = nodes[i], nodes[j]
            if not (forest and trees.root(a) == trees.root(b)) and similar(own[i], own[j], similarity):
                trees.link(a, b)
                found.append((a, b))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["a", "b"])

    return members.join(hashes.hint("merge"), "node").groupBy("block").applyInArrow(decide, "a long, b long")


def verified(links: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) among (a, b, n, m) whose shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in pair_blocks(*(c.to_numpy() for c in batch.columns)):
                yield block_batch(block)

    return saved(decided(links.select("a", "b", "n", "m").mapInArrow(run, BLOCK_SCHEMA), hashes, similarity, False), "verified")


def crowded_links(pairs: DataFrame, hashes: DataFrame, similarity: float, lim: Limits) -> DataFrame:
    """Links (a, b) that join the groups of ``pairs`` (tiles of node, size, fingerprint, group) as all similar pairs would.

    Every pair within the radius between two groups is decided by its shingle sets, unless its block has joined it.
    """
    width = 3 + WIDE_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, h in zip(batch.column(0), batch.column(1)):
                for block in apart_blocks(*(t.values.to_numpy().view(np.uint64).reshape(-1, width) for t in (g, h)), lim):
                    yield block_batch(block)

    return decided(pairs.mapInArrow(run, BLOCK_SCHEMA), hashes, similarity, True)


def similar_groups(docs: DataFrame, words: int = WIDE_WORDS, similarity: float = SIMILARITY, tile: int | None = None) -> DataFrame:
    """doc_id, row, component_id, first: groups of rows whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    component_id is a group's smallest doc_id, first the ``row_key`` of its first row by doc_id (rows without one last).
    A pair of sets of like size and similarity J has cosine c = 2J / (1 + J), and each bit of their
    fingerprints differs with chance acos(c) / pi. Pairs up to MARGIN standard deviations further apart than that are
    candidates, and every link is verified on its texts: first a spanning forest of the pairs as many deviations closer and
    all others between its trees; in crowded strips only the nearest of those. Nodes of crowded strips, and all of a
    tree of which a link failed, are then compared again: each candidate pair between two groups is decided on its texts. Cells are
    sizes in steps of the similarity, as sets whose sizes differ more cannot reach it, and population counts
    in steps of the widest radius. Sets of few shingles are far from that chance, as a set bit needs a strict majority:
    ``Limits`` has exact ones for their sizes. The comparison is the one of ``near_duplicates``, first of 128 bits with a radius
    that hardly any link exceeds, then of all bits.
    """
    lim = limits(similarity)
    marked = wide_fingerprints(docs, words).select("doc_id", "row", "n", "pop", "fp", F.xxhash64("fp").alias("k1"), F.xxhash64(F.lit("fp"), "fp").alias("k2"))
    marked = saved(marked, "wide-fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    reps = marked.groupBy("k1", "k2").agg(least.alias("least"), F.min("n").alias("n"), F.first("pop").alias("pop"), F.first("fp").alias("fp"))
    # texts of one fingerprint have one set, so any of them stands for it
    reps = saved(reps.withColumn("node", F.monotonically_increasing_id()), "wide-distinct")
    # a size on the edge of a step may fall to either side of it: the steps are a little wider than the similarity's
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1.001 / similarity)).cast("int")
    rows = reps.select("node", F.least(band, F.lit(127)).alias("band"), F.floor(F.col("pop") / (lim.widest + 1)).cast("int").alias("level"), F.concat(F.array("node", "n"), "fp").alias("row"))
    deltas = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    pairs = tile_pairs(rows, ["band", "level"], 128, "node", F.flatten(F.collect_list("row")), deltas, 128, 1 << 16, tile)
    links = saved(wide_links(pairs, lim), "wide-links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b"))
    hashes = shingles_of(reps.select("node", "least.row").join(ends.distinct().hint("merge"), "node"), docs, words)
    close = verified(links.where("a <> b"), hashes, similarity)
    roots = connected_components(close)
    crowd = links.where("a = b").select(F.col("a").alias("node"))
    sure = links.where("sure").select("a", "b")
    failed = saved(sure.join(close, ["a", "b"], "left_anti"), "failed")
    if not failed.isEmpty():
        trees = connected_components(sure)
        torn = trees.join(failed.select(F.col("a").alias("node")), "node", "left_semi").select("root").distinct()
        crowd = crowd.union(trees.join(torn, "root", "left_semi").select("node"))
    crowd = saved(crowd.distinct(), "crowded")
    if not crowd.isEmpty():
        # what the nearest of crowded strips left apart: all pairs between their groups
        roots = saved(roots, "wide-roots")
        again = rows.join(crowd, "node", "left_semi").join(roots, "node", "left").withColumn("row", F.concat("row", F.array(F.coalesce("root", "node"))))
        again = saved(again.select("node", "band", "level", "row"), "crowded-rows")
        pairs = tile_pairs(again, ["band", "level"], 128, "node", F.flatten(F.collect_list("row")), deltas, 128, 1 << 16, tile)
        rest = crowded_links(pairs, hashes, similarity, lim)
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest))
    named = saved(reps.select("k1", "k2", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "wide-roots")
    first = named.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"))
    # saved, so that the planner may split a group that many rows are in
    named = saved(named.join(saved(first, "wide-first"), "root").select("k1", "k2", "component_id", "first"), "wide-components")
    return marked.select("doc_id", "row", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "row", "component_id", "first")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
