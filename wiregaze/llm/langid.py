"""Language identification by compression: one raw-content zstandard dictionary per language.

A text is cut into blocks, every block is compressed with each language's dictionary, and the language with
the smallest sum wins. A narrow relative margin between the best two rejects the answer (``rejected``); the
answer itself stays in ``lang_pred``. Dictionaries come from a bounded hash sample of labelled documents
(``SAMPLE_DOCS`` a language, SAMPLE_CHARS of each from a place by hash, ``DICT_BYTES`` of text). Before, the sample is dealt
into FOLDS parts, and documents go whose label the dictionaries of the other parts contradict by a clear margin. All
classification covers whole texts.

Defined results: null text, or text without a letter, gives ``und`` with score 0; ties go to the language
with more sampled documents, then by name; no usable label at all gives ``und`` everywhere; repeated rows get the same
answer and are sampled together; texts of any length are cut into blocks and read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, table

SAMPLE_DOCS = 160
SAMPLE_CHARS = 40_000
FOLDS = 4
DICT_BYTES = 120_000
BLOCK_BYTES = 16_384
LEVEL = 9
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case words alone: case, digits and punctuation tell styles apart, not languages."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass")


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        import zstandard as zstd

        self.langs = list(dicts)
        self.tools = []
        for d in dicts.values():
            z = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(level=LEVEL)
            self.tools.append(zstd.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(t.compress(b)) for b in blocks) for t in self.tools]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """language, score, rejected."""
        if text is None or not self.tools or not LETTER.search(text):
            return "und", 0.0, True
        s = self.sizes(text)
        k = min(range(len(s)), key=s.__getitem__)
        other = min((x for i, x in enumerate(s) if i != k), default=2 * s[k])
        margin = (other - s[k]) / max(other, 1)
        return self.langs[k], margin / (margin + MARGIN), margin < MARGIN


_made: dict[int, Classifier] = {}


def shared(dicts: dict[str, bytes]) -> Classifier:
    """One classifier a Python worker, not one a task: compression contexts are large."""
    k = hash(tuple(sorted(dicts.items())))
    if k not in _made:
        _made.clear()
        _made[k] = Classifier(dicts)
    return _made[k]


def dictionaries(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """(lang, text) -> dictionary of each language, most sampled first."""
    by: dict[str, list[str]] = defaultdict(list)
    for lang, text in sample:
        by[lang].append(text)

    def build(groups: dict[str, list[str]]) -> dict[str, bytes]:
        out = {}
        for lang in sorted(groups, key=lambda x: (-len(groups[x]), x)):
            share = max(500, DICT_BYTES // max(1, len(groups[lang])))
            # an even share of each document first, so that no long one fills the dictionary
            raw = [plain(t) for t in groups[lang]]
            out[lang] = b" ".join([r[share:] for r in raw] + [r[:share] for r in raw])[-DICT_BYTES:]
        return out

    folds = [Classifier(build({lang: [t for i, t in enumerate(texts) if i % FOLDS != f] or texts for lang, texts in by.items()})) for f in range(FOLDS)]

    def agrees(lang: str, text: str, fold: int) -> bool:
        found, _, unsure = folds[fold].classify(text)
        return unsure or found == lang

    clean = {lang: [t for i, t in enumerate(texts) if agrees(lang, t, i % FOLDS)] for lang, texts in by.items()}
    return build({lang: clean[lang] or by[lang] for lang in by})


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionaries from labelled documents outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))]), F.col("lang"))
    # a long text gives a piece: about sample_docs texts a language, SAMPLE_CHARS at most, reach the driver
    start = F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1))
    piece = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = usable.where(draw < share).select("lang", "doc_id", piece.alias("text")).collect()
    return dictionaries([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def identify(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared(dicts)
        for b in batches:
            found = [c.classify(t.as_py()) for t in b.column(1)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
