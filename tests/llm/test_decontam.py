"""Leaks against a plain version, and cases of slots."""

from collections import Counter

import regex
from pyspark.sql import functions as F

from wiregaze.llm import decontam

SF = "/root/testdata/sf0.001"


def raw_tokens(text):
    t = regex.sub("[\x00-\x03]", " ", text or "")
    t = regex.sub(rf"(?i)({decontam.NUMBER})\s*({decontam.UNITS})(?![\p{{L}}\p{{N}}])", " \x01\\1 \x02\\2 ", t)
    t = regex.sub(rf"(?<!\x01)(?<![\d.,]){decontam.NUMBER}(?![\p{{L}}\p{{N}}])", lambda m: f" \x01{m[0]} ", t)
    t = regex.sub(r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "\x03\\1", t)
    out = [w for w in regex.split("[^\\p{L}\\p{N}\x01\x02\x03]+", t.lower()) if w]
    return ["\x01" + bare(w) if bare(w) in decontam.NUMBER_WORDS else w for w in out]


def bare(w):
    return w[1:] if w < "\x04" else w


def kind_of(w):
    return w[0] if w < "\x04" else w


def grams(types, n):
    return [tuple(types[i : i + n]) for i in range(len(types) - n + 1)]


def brute(docs, items):
    out = {}
    for item_id, text in items:
        raw = raw_tokens(text)
        n = min(5, len(raw))
        if n < 3:
            continue
        types = [kind_of(w) for w in raw]
        places = {}
        for p, g in enumerate(grams(types, n)):
            places.setdefault(g, []).append(p)
        for doc_id, body in docs:
            theirs = raw_tokens(body)
            seen = {}
            for p, g in enumerate(grams([kind_of(w) for w in theirs], n)):
                if g in places:
                    seen.setdefault(g, p)
            if not seen or len(seen) < 2 and len(places) > 1:
                continue
            shifts = Counter(p - places[g][0] for g, p in seen.items())
            start = min(s for s, c in shifts.items() if c == max(shifts.values()))
            under = {q + k for g, p in seen.items() if abs(p - places[g][0] - start) <= max(2, len(raw) * 0.2) for q in places[g] for k in range(n)}
            share = len(seen) / len(places)
            if share < 0.6 and len(under) < len(raw) * 0.25:
                continue
            at = lambda i: theirs[start + i] if 0 <= start + i < len(theirs) else None
            agrees = sum(i in under or at(i) is not None and (kind_of(w) == kind_of(at(i)) or bare(w) == bare(at(i))) for i, w in enumerate(raw))
            if share < 0.6 and agrees < len(raw) * 0.75:
                continue
            pairs = [(w, at(i)) for i, w in enumerate(raw) if start + i >= 0]
            slots = [(a, b) for a, b in pairs if b is not None and a < "\x04" and kind_of(a) == kind_of(b)]
            plain = [(a, b) for a, b in pairs if a >= "\x04"]
            own = [i for i, w in enumerate(raw) if w >= "\x04"]
            covered = max(sum(a == b for a, b in plain) / max(1, len(plain)), sum(i in under for i in own) / max(1, len(own)))
            changed = sum(a != b for a, b in slots)
            steady = len(set(slots)) == len({a for a, _ in slots})
            kind = "verbatim" if not changed else "reparameterised" if steady and len(plain) >= 3 else "similar"
            if kind != "similar" or covered >= 0.6:
                out[doc_id, item_id] = (round(share, 9), start, len(slots), changed, steady, kind)
    return out


def planted():
    q = "Tom has five apples and gives 2 of them to Ann . Tom then walks 30 km to the next town , so how many apples has Tom left ?"
    items = [(1, q), (2, "how many"), (3, "the red fox"), (4, None), (5, ""), (6, q), (7, "Sum Of All Angles In Any Triangle Shape"), (8, "we count forty two birds in the old tree")]
    swap = q.replace("Tom", "Joe").replace("Ann", "Eve").replace("five", "nine").replace("30", "12")
    docs = [(1, q), (2, "so . " + swap + " end"), (3, swap.replace("has Joe left", "has Max left")), (4, q.lower()), (5, "see the red fox run"), (6, None), (7, ""), (8, "Go To Any New Place In Town Today And Rest There"), (9, "we count sixty two birds in the old tree"), (10, "x " * 5000 + q + " y" * 5000), (11, swap.replace("Joe", "Amy").replace("apples", "plums"))]
    return docs, items


def test_planted_leaks_equal_brute_force(spark):
    docs, items = planted()
    extra = [(d, t, "h", 0) for d, t in docs]
    got = decontam.leaks(spark.createDataFrame(extra + extra[:1], "doc_id long, text string, h string, pos int"), spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, kind string"))
    found = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["start"], r["slots"], r["changed"], r["consistent"], r["kind"]) for r in got.collect()}
    assert found == brute(docs, items)
    kinds = {k: v[-1] for k, v in found.items()}
    assert kinds[1, 1] == kinds[1, 6] == kinds[10, 1] == "verbatim" and kinds[2, 1] == kinds[9, 8] == "reparameterised" and kinds[5, 3] == "verbatim"
    assert kinds[3, 1] == "similar" and (4, 1) in kinds and (8, 7) not in kinds and not any(i in (2, 4, 5) for _, i in kinds)
    assert decontam.leaks(got.sparkSession.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_leaks_of_the_tables_equal_brute_force(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = {}
    for size in (8 << 20, -1):  # by broadcast and by merge
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
        rows[size] = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["start"], r["slots"], r["changed"], r["consistent"], r["kind"]) for r in decontam.op6_decontam(spark, SF).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows[-1] == rows[8 << 20] == want and len(want) > 2


def test_tokens_equal_their_definition(spark):
    texts = ["Five cats, 3.5 km; 20KM and x2 2x. ÉTÉ Été éTé", "one-two ONE Two\x01\x03 3", "a\tb\n12,5 %", "Zwölf Äpfel 7kg", ""]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(decontam.marked(decontam.tokens(F.col("x"))).alias("t")).collect()]
    assert got == [raw_tokens(t) for t in texts]
