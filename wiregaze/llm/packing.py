"""Mixture-controlled packing: deficit round-robin over one queue per source.

Two passes. The first tokenises every text once and keeps the ids (16 or 32 bits each) in the shared
folder. The second deals documents by a hash of doc_id into buckets of about ``bucket_tokens`` ids, and
fills windows of ``window`` ids from one queue per source. Each window credits every source its target
share; a source is served what it is owed, and what it got too much or too little stays as its deficit,
within a bucket from window to window, and between buckets through prefix sums of the buckets' supply, so
that all buckets still run in parallel. The id stream of a bucket is cut at every ``window`` ids; its tail
is cut at powers of two, which need no padding.

Defined results: null or empty text is the end id alone; null source is a queue of its own; repeated rows
are packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

WINDOW = 2048
#: Least ids served at a turn while others are owed more; keeps pieces long when sources are many.
QUANTUM = 64
BUCKET_TOKENS = 2_000_000
#: Most words whose ids a task keeps, and texts encoded together.
CACHE_PARTS = 600_000
TOGETHER = 64
#: How the vocabulary's file splits a text, in terms of Python's classes.
PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Numbers that Python counts as letters, separators it counts as white space, and a letter it lowers by context.
APART = ("\x1c", "\x1d", "\x1e", "\x1f", "\0")
ODD = regex.compile(r"[\p{Nl}\p{No}\x1c-\x1f\x00\u03a3]")
_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class PartEncoder:
    """Ids of texts as bytes, by the words between white space and the pre-tokens that the tokenizer itself cuts them into; seen ones are kept.

    The pre-tokens of many texts' new words that are not known yet are encoded together, and told apart by their last
    tokens, which alone end a word. Where the vocabulary marks no word ends, texts are encoded whole, as are
    those few whose characters Python and the tokenizer treat differently.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u4" if size > 65536 else "<u2")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = np.zeros(size, bool)
        for t, i in self.tok.get_vocab().items() if suffix else ():
            self.last[i] = t.endswith(suffix)
        self.marked = bool(suffix)
        self.parts: dict[str, bytes] = {}
        self.merger = self._merger(suffix) if suffix else None

    def _merger(self, suffix: str):
        """The same merges by ranks, several times as fast on single words: ids rise in the order of merges.

        A zero byte stands for the end of a word; texts that hold one are encoded whole.
        """
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        letters = sorted(ByteLevel.alphabet())  # one character for each byte: itself, or the next free one from 256
        own = {c: ord(c) for c in letters if ord(c) < 256}
        rest = iter(sorted(set(range(256)) - set(own.values())))
        own |= {c: next(rest) for c in letters if ord(c) >= 256}
        ranks = {}
        for t, i in self.tok.get_vocab(with_added_tokens=False).items():
            word = t.removesuffix(suffix)
            raw = bytes(own[c] for c in word) if all(c in own for c in word) else None
            if raw is not None:
                ranks.setdefault(raw + b"\0" * t.endswith(suffix), i)
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("own", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            if self.merger is not None:
                ids = np.array(self.merger.encode_ordinary("\0".join(some) + "\0"), self.kind)
            else:
                ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # a part that is no single word to the tokenizer
                self.parts |= {p: self.whole(p) for p in some}
                continue
            raw, k, start = ids.tobytes(), self.kind.itemsize, 0
            for p, end in zip(some, ends.tolist()):
                self.parts[p] = raw[start : end * k]
                start = end * k

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | bytes] = []
        for t in texts:
            if not self.marked or (any(map(t.__contains__, APART)) if t.isascii() else ODD.search(t)):
                cut.append(self.whole(t))
                continue
            # white space is no part of any pre-token
            cut.append((t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower().split())
        kinds = set().union(*[c for c in cut if isinstance(c, list)])
        new = kinds.difference(self.parts)
        if len(self.parts) + len(new) > CACHE_PARTS:
            self.parts.clear()
            new = kinds
        get = self.parts.__getitem__
        words = {w: PRETOKEN.findall(w) for w in new}
        self.learn(list(set().union(*words.values()).difference(self.parts)))
        for w, own in words.items():
            if w not in self.parts:
                self.parts[w] = b"".join(map(get, own))
        return [c if isinstance(c, bytes) else b"".join(map(get, c)) for c in cut]


def encoder(path: str) -> PartEncoder:
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = PartEncoder(path)
    return _tokenizers[path]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(doc_id, source, n, ids): ids little-endian, 2 or 4 bytes each, ``end_id`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                s = b.slice(at, TOGETHER)
                ids = [x + end for x in enc.encode([t or "" for t in s.column(2).to_pylist()])]
                n = [len(x) // enc.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])
        # the worker lives on, also for other stages
        enc.parts = {}
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, source string, n long, ids binary")


def fill(counts: list[list[int]], shares: np.ndarray, owed: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Deficit round-robin over queues of documents of the given lengths.

    counts[s]: lengths of source s's documents in queue order. Yields (source, document index in its queue,
    start, length, sequence index, offset). ``owed`` (ids) is updated in place.
    """
    left = np.array([sum(c) for c in counts], dtype=np.int64)
    at = [[0, 0] for _ in counts]
    total, seq = int(left.sum()), 0
    while total:
        size = min(window, 1 << (total.bit_length() - 1))
        live = left > 0
        weight = np.where(live, shares, 0.0)
        weight = weight / weight.sum() if weight.sum() > 0 else live / live.sum()
        owed += weight * size
        room, offset = size, 0
        order = [int(s) for s in np.argsort(-owed, kind="stable") if live[s]]
        for most in (False, True):  # what is owed, then whoever is next
            for s in order:
                if not room:
                    break
                give = int(min(left[s], room if most else min(room, owed[s])))
                if give <= 0 or not most and give < quantum and give < left[s]:
                    continue
                owed[s] -= give
                left[s] -= give
                room -= give
                while give:
                    d, start = at[s]
                    n = min(give, counts[s][d] - start)
                    yield s, d, start, n, seq, offset
                    offset += n
                    give -= n
                    at[s] = [d, start + n] if start + n < counts[s][d] else [d + 1, 0]
        total -= size
        seq += 1


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, targets: dict[str, float] | None = None, bucket_tokens: int = BUCKET_TOKENS, quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    targets: token share of each source, any scale; by default the shares of the input, so that no queue
    runs dry early. A source without a target waits until the others are used up.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    tokenizer = tokenizer or default_tokenizer()
    kept = saved(tokenised(docs, tokenizer, end_id), "ids", compression="zstd")
    total = kept.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("long")).withColumn("source", F.coalesce("source", F.lit("\x00")))
    # rows: buckets x sources; the supply of all buckets before this one, per source
    supply = dealt.groupBy("bucket", "source").agg(F.sum("n").alias("n"))
    supply = saved(supply, "supply")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    ahead = supply.groupBy("bucket").agg(F.sum("n").alias("t")).withColumn("used", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    own = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    if targets is None:
        goal = supply.groupBy("source").agg((F.sum("n") / F.lit(float(total or 1))).alias("share"))
    else:
        scale = float(sum(targets.values())) or 1.0
        goal = docs.sparkSession.createDataFrame([(s, v / scale) for s, v in targets.items()] or [("", 0.0)], "source string, share double")
    state = (
        supply.withColumn("had", F.coalesce(F.sum("n").over(own), F.lit(0)))
        .join(goal, "source", "left")
        .join(ahead, "bucket")
        .withColumn("share", F.coalesce("share", F.lit(0.0)))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("source", "share", (F.col("share") * F.col("used") - F.col("had")).alias("owed"))).alias("queues"))
    )

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        left = left.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        st = right.slice(0, 1).to_pylist()[0]
        src, doc, n, ids = (left.column(c) for c in ("source", "doc_id", "n", "ids"))
        doc, n, src = doc.to_pylist(), n.to_pylist(), src.to_pylist()
        kind = np.dtype(f"<u{len(ids[0].as_buffer()) // n[0]}")
        place = {s: k for k, s in enumerate(sorted(set(src)))}
        queues: list[list[int]] = [[] for _ in place]
        for k, s in enumerate(src):
            queues[place[s]].append(k)
        share, owed = ({q["source"]: q[k] for q in st["queues"]} for k in ("share", "owed"))
        shares = np.array([share.get(s, 0.0) for s in place])
        debts = np.array([owed.get(s, 0.0) for s in place])
        cols: list[list] = [[] for _ in range(9)]
        base = int(st["bucket"]) << 36
        for s, d, start, length, seq, offset in fill([[n[k] for k in q] for q in queues], shares, debts, window, quantum):
            k = queues[s][d]
            words = np.frombuffer(ids[k].as_buffer(), kind)
            piece = words[start : start + length].astype("<u4").tobytes()
            for c, v in zip(cols, (doc[k], start, length, zlib.crc32(piece), n[k], base + seq, offset, None if src[k] == "\x00" else src[k], piece)):
                c.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary())])
    return dealt.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
