"""Surrogates for personal data and secrets: keyed, type-consistent, distinct.

Detectors find e-mail addresses, telephone, card and account numbers, IP addresses, social-security
numbers, access keys, assigned secrets, and names after a title. A value's canonical form and a secret key
give its surrogate, so the same entity gets the same one in every document and spelling; the surrogate keeps
type, length, script and punctuation, check digits that were right stay right, and a given name keeps the gender
of its title. Names are replaced word by word, given names and surnames, so that "Mr John Smith", "Mr Smith" and, in a
document that holds one of these, "John" and "Smith" alone stay one person. Distinct values of a type must get distinct
surrogates, none of them a value that occurs: candidates are grouped in Spark, all but the first of a clash draw
again, until none is left. Surrogates of later draws are longer or of wider ranges, so that they do not run out; numbers
of fixed length (telephone, card, account, social-security) keep theirs, and only where a length's numbers are all but
used up does the job stop, after MAX_DRAWS. Only values that drew again need a lookup; it is joined to the documents that hold them.

Defined results: null text stays null with no entities; empty text stays empty; overlapping matches go to
the earlier, then longer, then first type below; repeated rows are replaced alike; texts of any length are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: The default only makes results repeatable; a deployment passes its own.
DEFAULT_KEY = b"wiregaze"
BROADCAST_BYTES = 4 << 20
MAX_DRAWS = 64
# What precedes a name, by gender; word starts of secrets; alphabets by script.
MALE = ("mr", "sr", "señor", "senor", "herr", "monsieur", "sir")
FEMALE = ("mrs", "ms", "miss", "sra", "señora", "senora", "frau", "mme", "madame", "lady")
SECRET_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|client[_-]?secret|session[_-]?id"
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")
NAME_PARTS = {0: ("ba da fe ga ka li ma ne ro sa ti va be do lu ra", "n r s d l m t k", "a ina ela ia isa ana ora eta"), 1: ("ба да ве га ка ли ма не ро са ти ва", "н р с д л м т к", "а ина ела ия"), 2: ("βα δα κα λι μα νε ρο σα τι", "ς ν ρ", "α ινα ια ελα")}
TITLES = MALE + FEMALE
#: Texts without any of these hold nothing that a detector finds: all but those of the second need a digit or an @.
HINT = re.compile(r"[@\d]")
HINT_WORDS = re.compile(rf"akia|asia|{SECRET_NAMES}|\b(?:{'|'.join(TITLES)})\b")
# What matches an ASCII letter without regard to case, and is not lowered to it.
LIKE_ASCII = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"))
DETECTORS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("secret", re.compile(rf"(?i)\b(?:[a-z]+[_-])?(?:{SECRET_NAMES})\b[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"',;&<>]{{6,}})")),
    ("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\d)")),
    ("token", re.compile(r"(?<![A-Za-z0-9])(?=[a-f0-9]*\d)(?=[a-f0-9]*[a-f])[a-f0-9]{32,}(?![A-Za-z0-9])")),
    ("name", re.compile(rf"\b(?i:(?P<t>{'|'.join(TITLES)}))\.?\s+(?P<v>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+){{0,2}})")),
)
NAME_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        s += d - 9 * (d > 9)
    return s % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, value: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind in ("email", "given_m", "given_f", "surname"):
        return value.lower()
    return value


def hinted(text: str) -> bool:
    if HINT.search(text):
        return True
    low = text.lower()
    if not text.isascii():
        for c, a in LIKE_ASCII:
            low = low.replace(c, a)
    return HINT_WORDS.search(low) is not None


def is_ip6(value: str) -> bool:
    groups = [g for g in value.split(":") if g]
    if len(groups) < 2 or not any(c.isdigit() for c in value):
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def names(text: str, titled: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the words of titled names (start, end, male), and of the same words elsewhere in the text.

    The last of several words is a surname, hyphens apart, the others are given names; a word alone is a surname
    unless the text has it as a given name.
    """
    kinds: dict[str, str] = {}
    alone = []
    for a, b, male in titled:
        cut = a + text[a:b].rfind(" ") + 1
        if cut == a:
            alone.append((a, b))
            continue
        for m in NAME_WORD.finditer(text, a, b):
            kinds.setdefault(m[0].lower(), "surname" if m.start() >= cut else "given_m" if male else "given_f")
    for a, b in alone:
        for m in NAME_WORD.finditer(text, a, b):
            kinds.setdefault(m[0].lower(), "surname")
    if kinds:
        for m in NAME_WORD.finditer(text):
            if not m[0][0].islower() and (kind := kinds.get(m[0].lower())):
                yield *m.span(), kind


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) in order, without overlaps."""
    if not text or not hinted(text):
        return []
    found = []
    for rank, (kind, pattern) in enumerate(DETECTORS):
        titled = []
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            value = text[a:b]
            if kind == "card":
                d = re.sub(r"\D", "", value)
                if len(d) != 16 and not luhn(d):
                    continue
            elif kind == "iban" and mod97(value.replace(" ", "")) != 1 or kind == "ip6" and not is_ip6(value):
                continue
            elif kind == "phone" and not 9 <= sum(c.isdigit() for c in value) <= 15 or kind == "phone" and re.fullmatch(r"\d{4}[ .-]\d{4}", value):
                continue
            elif kind == "name":
                titled.append((a, b, m["t"].lower() in MALE))
                continue
            found.append((a, -b, rank, kind, value))
        found += [(a, -b, rank, k, text[a:b]) for a, b, k in names(text, titled)]
    out: list[tuple[int, int, str, str]] = []
    end = 0
    for a, nb, _, kind, value in sorted(found):
        if a >= end:
            out.append((a, -nb, kind, canonical(kind, value)))
            end = -nb
    return out


class Stream:
    """Numbers below a bound, fixed by key, kind, value and draw."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.pool = key, "\x1f".join(what).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def like(c: str, s: Stream, hexa: bool = False) -> str:
    """Another character of the same kind and script."""
    if c.isdigit():
        return str(s.below(10))
    if hexa:
        return "abcdef"[s.below(6)]
    if not c.isalpha():
        return c
    for letters in SCRIPTS:
        if c.lower() in letters:
            break
    else:
        letters = SCRIPTS[0]
    r = letters[s.below(len(letters))]
    return r.upper() if c.isupper() else r


def surrogate(kind: str, value: str, key: bytes = DEFAULT_KEY, draw: int = 0) -> str:
    """The canonical surrogate of a canonical value. Later draws are longer or of wider ranges."""
    s = Stream(key, kind, value, str(draw))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        d = Stream(key, "domain", domain, "0")
        # reserved names for what others could own; the label count stays
        host = ["".join(like(c, d) for c in x) for x in labels[:-2]] + ["example", labels[-1] if labels[-1] in ("com", "org", "net") else "com"]
        return "".join(like(c, s) for c in local) + "".join(str(s.below(10)) for _ in range(draw)) + "@" + ".".join(host)
    if kind == "ip":
        # private, then reserved, then any addresses
        first = 10 if draw < 3 else 240 + s.below(16) if draw < 12 else s.below(256)
        return f"{first}.{s.below(256)}.{s.below(256)}.{s.below(256)}"
    if kind == "ip6":
        # private; zero groups stay, so that it is shortened alike, but for later draws
        groups = value.split(":")
        return ":".join([f"fd{s.below(256):02x}"] + [g if draw < 3 and g == "0000" else f"{1 + s.below(0xFFFF):04x}" for g in groups[1:]])
    if kind == "access_key":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in value[4:])
    if kind == "card":
        d = value[0] + "".join(str(s.below(10)) for _ in value[1:])
        return next(x for x in (d[:-1] + str(i) for i in range(10)) if luhn(x)) if luhn(value) else d
    if kind == "iban":
        rest = "".join(like(c, s) for c in value[4:])
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + rest):02d}{rest}"
    if kind == "phone":
        keep = 1 if len(value) in (11, 12, 13) else 0
        return value[:keep] + str(2 + s.below(8) if draw < 4 else s.below(10)) + "".join(str(s.below(10)) for _ in value[keep + 1 :])
    if kind in ("given_m", "given_f", "surname"):
        script = next((i for i, letters in enumerate(SCRIPTS) if value[0] in letters), 0)
        starts, closes, soft = (x.split() for x in NAME_PARTS[script])
        word = "".join(starts[s.below(len(starts))] for _ in range(2 + draw))
        return word + (soft[s.below(len(soft))] if kind == "given_f" else closes[s.below(len(closes))])
    hexa = re.fullmatch(r"[a-f0-9]+", value) is not None
    more = "" if kind == "ssn" else "0" * max(0, draw - 2)
    return "".join(like(c, s, hexa and not c.isdigit()) for c in value + more)


def laid_out(kind: str, original: str, new: str) -> str:
    """The canonical surrogate in the punctuation and case of the original."""
    if kind in ("phone", "card", "ssn"):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in original)
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in original)
    if kind in ("given_m", "given_f", "surname"):
        return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()
    if kind == "ip6":
        short = str(ipaddress.IPv6Address(new)) if "::" in original else ":".join(g.lstrip("0") or "0" for g in new.split(":"))
        return short.upper() if original.upper() == original else short
    if kind == "email":
        return new.upper() if original.isupper() else new
    return new


def replaced(text: str, found: list[tuple[int, int, str, str]], key: bytes, draws: dict[tuple[str, str], int]) -> str:
    parts, at = [], 0
    for a, b, kind, value in found:
        new = surrogate(kind, value, key, draws.get((kind, value), 0)) if draws else surrogate(kind, value, key)
        parts += [text[at:a], laid_out(kind, text[a:b], new)]
        at = b
    return "".join(parts) + text[at:]


def draws_of(values: DataFrame, key: bytes) -> DataFrame:
    """kind, value of all distinct entities -> those that need draw > 0, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, value, draw = (c.to_pylist() for c in b.columns)
            new = [surrogate(*x[:2], key, x[2]) for x in zip(kind, value, draw)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(new, pa.string())], ["kind", "value", "draw", "new"])

    schema = "kind string, value string, draw int, new string"
    state = saved(values.withColumn("draw", F.lit(0)).mapInArrow(run, schema), "drawn")
    for _ in range(MAX_DRAWS):
        # the first value of a clash keeps its surrogate, so at least one settles in each round
        first = state.groupBy("kind", "new").agg(F.min(F.struct("draw", "value")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        clash = state.join(first, ["kind", "new"]).where("struct(draw, value) <> keeps").select("kind", "value")
        # a surrogate that is itself a value of the corpus; it may not name someone else
        taken = state.select("kind", F.col("new").alias("value"), F.col("value").alias("of")).join(values, ["kind", "value"], "left_semi").select("kind", F.col("of").alias("value"))
        again = saved(clash.union(taken).distinct(), "again")
        if again.isEmpty():
            return state.where("draw > 0").select("kind", "value", "draw")
        redo = state.join(again, ["kind", "value"], "left_semi").select("kind", "value", (F.col("draw") + 1).alias("draw")).mapInArrow(run, schema)
        state = saved(state.join(again, ["kind", "value"], "left_anti").union(redo), "drawn")
    raise RuntimeError("surrogates did not become distinct: a type has more values than its format has surrogates")


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (start, end in the old text; kind; surrogate not stored)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(d, k, v) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for _, _, k, v in entities(t.as_py())}
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["row", "kind", "value"])

    found = saved(docs.select("row", "text").mapInArrow(find, "row long, kind string, value string"), "entities")
    draws = saved(draws_of(saved(found.select("kind", "value").distinct(), "values"), key), "draws")
    own = found.join(draws, ["kind", "value"]).groupBy("row").agg(F.collect_set(F.struct("kind", "value", "draw")).alias("draws"))
    own = saved(own, "own-draws")
    size = own.agg(F.sum(F.aggregate("draws", F.lit(0), lambda n, x: n + F.length(x["value"]) + 64))).first()[0] or 0
    if size:
        docs = docs.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "row", "left")
    else:
        docs = docs.withColumn("draws", F.lit(None).cast("array<struct<kind:string,value:string,draw:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            texts, spans = [], []
            for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                e = entities(t)
                texts.append(replaced(t, e, key, {(x["kind"], x["value"]): x["draw"] for x in d or ()}) if e else t)
                spans.append([{"start": x[0], "end": x[1], "kind": x[2]} for x in e])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_entities", "entities"])

    return docs.select("doc_id", "text", "draws").mapInArrow(run, "doc_id long, text string, n_entities long, entities array<struct<start:int,end:int,kind:string>>")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
