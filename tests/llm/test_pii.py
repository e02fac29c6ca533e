"""Surrogates: against a plain version of the draws, at the limits of formats, and for entities that recur."""

import re

import pytest
from pyspark.sql import functions as F

from wiregaze.llm import pii


def brute(texts):
    """All texts by one dictionary of draws."""
    found = [pii.entities(t) for t in texts]
    values = {(k, v) for e in found for _, _, k, v in e}
    draws = dict.fromkeys(values, 0)
    while True:
        new = {x: pii.surrogate(*x, pii.DEFAULT_KEY, d) for x, d in draws.items()}
        first = {}
        for (k, v), n in sorted(new.items(), key=lambda x: (draws[x[0]], x[0][1])):
            first.setdefault((k, n), v)
        again = [(k, v) for (k, v), n in new.items() if first[k, n] != v or (k, n) in values]
        if not again:
            break
        for x in again:
            draws[x] += 1
    out = []
    for t, e in zip(texts, found):
        parts, at = [], 0
        for a, b, k, v in e:
            parts += [t[at:a], pii.laid_out(k, t[a:b], new[k, v])]
            at = b
        out.append(None if t is None else "".join(parts) + t[at:])
    return out


def corpus():
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"write {c}@site{i}.com or {c}{c}@site{i}.org from 10.1.{i}.{j}" for j, c in enumerate(letters) for i in range(12)]
    texts += [f"Mr {a}{b}{c} came and Mrs {c}{b}an {a}il met Sir {b}{a}{c}" for a in ("Bo", "Ke", "Lu") for b in ("ra", "to", "mi") for c in ("n", "sk", "v")]
    return texts + [None, "", "nothing here", texts[0], "x " * 200_000 + texts[1] + " y" * 200_000]


def test_texts_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", "v", i) for i, t in enumerate(texts)], "doc_id long, text string, kind string, value string, draws long")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == brute(texts)
    for i, t in enumerate(texts[:-1]):  # outside the spans nothing changes
        ends = [0] + [x for e in got[i]["entities"] for x in (e["start"], e["end"])] + [len(t or "")]
        pieces = [re.escape((t or "")[a:b]) for a, b in zip(ends[::2], ends[1::2])]
        assert re.fullmatch(r"\S+?".join(pieces), got[i]["text"] or "")
    assert pii.pseudonymise(docs.where("doc_id < 0")).count() == 0
    assert pii.pseudonymise(docs.union(docs).where("doc_id < 5")).count() == 10


def test_formats_do_not_run_out(spark):
    """A thousand one-letter addresses, sixty thousand names, all six-digit secrets of one shape, a crowded address range."""
    values = [("email", f"{chr(97 + i % 26)}@h{i}.com") for i in range(1000)] + [("surname", f"w{i}") for i in range(60_000)] + [("secret", f"{i:06d}") for i in range(0, 1_000_000, 50)] + [("ip", f"10.{i}.{j}.7") for i in range(256) for j in range(8)]
    frame = spark.createDataFrame(values, "kind string, value string").repartition(4)
    drawn = {(r["kind"], r["value"]): r["draw"] for r in pii.draws_of(frame, b"k").collect()}
    final = [(k, pii.surrogate(k, v, b"k", drawn.get((k, v), 0))) for k, v in values]
    assert len(set(final)) == len(final) and not set(final) & set(values)


def new(text):
    return pii.replaced(text, pii.entities(text), b"k", {})


def test_a_person_stays_one():
    got = new("Mr. John Smith spoke. Mr. Smith left; Smith, said John, was late. SMITH! A blacksmith smiths. Mrs Ann Smith-Jones stayed, Jones too.")
    w = re.fullmatch(r"Mr\. (\w+) (\w+) spoke\. Mr\. (\w+) left; (\w+), said (\w+), was late\. (\w+)! A blacksmith smiths\. Mrs (\w+) (\w+)-(\w+) stayed, (\w+) too\.", got).groups()
    assert w[1] == w[2] == w[3] == w[7] and w[0] == w[4] and w[5] == w[1].upper() and w[8] == w[9]
    assert len({w[0], w[1], w[6], w[8]}) == 4 and not {"John", "Smith", "Ann", "Jones"} & set(w)
    assert any(w[6].lower().endswith(x) for x in pii.NAME_PARTS[0][2].split())
    assert new("The lady of the house") == "The lady of the house" and "Иван" not in new("Mr Иван came") and re.search("[а-я]", new("Mr Иван came"))


@pytest.mark.parametrize("value", ["2001:db8::ff00:42:8329", "2001:0db8:0000:0000:0000:ff00:0042:8329", "fe80::1", "2A00:1450:4001:81B::200E"])
def test_ip6(value):
    text = f"from {value}, twice {value}"
    got = new(text)
    assert value not in got and len(pii.entities(text)) == 2
    a, b = re.fullmatch(r"from (\S+), twice (\S+)", got).groups()
    assert a == b and pii.is_ip6(a) and ("::" in a) == ("::" in value)


@pytest.mark.parametrize("text", ["at 12:30:45 today", "std::vector and a::b", "ratio 3:4:5", "f::", ":: 1", "page 12 of 30"])
def test_not_ip6(text):
    assert new(text) == text


@pytest.mark.parametrize("text", ["acceſſ_key=abcdefgh", "paſsword: hunterhunter", "AUTHORİZATION = abcdefgh", "mıss Quimby", "no hint", "a toKen=abcdefgh"])
def test_hint_never_hides_a_match(text, monkeypatch):
    with_hint = pii.entities(text)
    monkeypatch.setattr(pii, "hinted", lambda t: True)
    assert pii.entities(text) == with_hint


def test_hint_on_all_documents(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").isNotNull()).collect()]
    with_hint = [pii.entities(t) for t in texts]
    monkeypatch.setattr(pii, "hinted", lambda t: True)
    assert [pii.entities(t) for t in texts] == with_hint
