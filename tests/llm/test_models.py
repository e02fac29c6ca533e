"""The fitted operators, the link graph and the search against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiregaze.llm import langid, quality, topk, urls

SF = "/root/testdata/sf0.001"


# ---- quality


def test_fit_equals_dense_least_squares(spark):
    """One matrix instead of summed parts; isotonic by minimal means of intervals."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("h")).collect()}
    rows = [(r["doc_id"], quality.statistics(r["text"])) for r in docs.collect() if r["doc_id"] in marks]
    x, y = np.array([s for _, s in rows]), np.array([marks[d] for d, _ in rows], float)
    fit = np.array([half[d] == 0 for d, _ in rows])
    plain = quality.Model(x.mean(axis=0), x.std(axis=0), quality.FOURIER)
    f = plain.map(x[fit])
    plain.coef = np.linalg.lstsq(np.vstack([f / math.sqrt(len(f)), math.sqrt(quality.RIDGE) * np.eye(f.shape[1])]), np.concatenate([y[fit] / math.sqrt(len(f)), np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.allclose(plain.raw(x), model.raw(x), atol=1e-6)


def test_isotonic_equals_its_definition():
    rng = np.random.default_rng(3)
    raw, y = np.sort(rng.random(60)), (rng.random(60) < np.linspace(0.1, 0.9, 60)).astype(float)
    # the max of the min of means over intervals that end and start here
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    x, v = quality.isotonic(raw, y)
    groups = [list(np.nonzero(np.isclose(want, w))[0]) for w in sorted(set(np.round(want, 12)))]
    assert np.allclose(x[1:-1], [raw[g].mean() for g in groups])
    assert np.allclose(v[1:-1], np.maximum.accumulate([(y[g].sum() + 0.5) / (len(g) + 1) for g in groups]))


def test_quality_of_long_texts_ties_and_copies(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "a fine day"), (3, "a fine day"), (2, "a fine day"), (4, None), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and by[2] == by[3] and by[4] == by[5] and all(0 <= s <= 1 for s in by.values())


# ---- language


def test_classifier_equals_its_definition():
    import zstandard as zstd

    dicts = {"en": b"the quick brown fox jumps over the lazy dog and then the other one", "de": "der schnelle braune fuchs springt über den faulen hund und dann".encode()}
    c = langid.Classifier(dicts)
    for text in ("The fox jumps over the other dog.", "Der Hund springt über den Fuchs", "x" * 50_000 + " fox", "the der"):
        raw = " ".join(w for w in "".join(ch if ch.isalpha() else " " for ch in text.lower()).split()).encode()
        sizes = {}
        for lang, d in dicts.items():
            total = 0
            for i in range(0, len(raw), langid.BLOCK_BYTES):
                z = zstd.ZstdCompressor(level=langid.LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
                total += len(z.compress(raw[i : i + langid.BLOCK_BYTES]))
            sizes[lang] = total
        small, large = sorted(sizes.values())
        lang, score, rejected = c.classify(text)
        margin = (large - small) / large
        assert abs(sizes[lang] - small) <= 1 + small // 100 and abs(score - margin / (margin + langid.MARGIN)) < 0.1 and rejected == (margin < langid.MARGIN) or rejected


def test_wrong_labels_leave_the_sample():
    rng = np.random.default_rng(1)
    en, de = "the of and to in that was his with for on are".split(), "der die und das ist von mit den nicht ein auf sich".split()
    text = lambda words: " ".join(rng.choice(words, 60))
    wrong = text(de) + " zeitungsartikel"
    dicts = langid.dictionaries([("en", text(en)) for _ in range(40)] + [("en", wrong)] + [("de", text(de)) for _ in range(40)])
    assert b"zeitungsartikel" not in dicts["en"] and b"the" in dicts["en"] and b"und" in dicts["de"]


def test_language_of_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(i, ("the quick dog " * 9 if i % 2 else "der schnelle hund ") * (20_000 if i < 3 else 5), "en" if i % 2 else "de") for i in (1, 2, 3, 4, 6, 7, 8, 9, 3, 4)], "doc_id long, text string, lang string")
    dicts = langid.learn(docs)
    got = langid.identify(docs, dicts).collect()
    assert len(got) == 10 and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got)
    assert langid.identify(docs.where("doc_id < 0"), dicts).count() == 0


# ---- links


def test_scores_equal_the_dense_solution(spark):
    """A thousand hosts with hubs and cycles; (I - damping * shares) score = seed."""
    rng = np.random.default_rng(6)
    n = 1000
    hub = rng.integers(0, 20, 4000)
    ends = Counter(zip(rng.integers(0, n, 4000).tolist(), hub.tolist())) + Counter(zip(hub.tolist(), rng.integers(0, n, 4000).tolist())) + Counter((i, (i + 1) % 300) for i in range(300))
    edges = [(a, b, w) for (a, b), w in ends.items() if a != b]
    seed = (rng.random(n) < 0.05).astype(float)
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[b, a] = w
    out = m.sum(axis=0)
    want = np.linalg.solve(np.eye(n) - urls.DAMPING * m / np.where(out, out, 1), seed)
    got = urls.spread(spark.createDataFrame([("trust", str(i), float(s)) for i, s in enumerate(seed)], "side string, host string, seed double"), spark.createDataFrame([("trust", str(a), str(b), w) for a, b, w in edges], "side string, src string, dst string, weight long"))
    found = np.zeros(n)
    for r in got.collect():
        found[int(r["host"])] = r["score"]
    assert np.abs(found - want).sum() <= 2 * urls.TOLERANCE * seed.sum()


def test_verdicts_of_a_linked_site_equal_the_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(9)
    tlds = ["net/es/", "net/fr/", "net/de/", "com/", "org/", "example.com/en/"]
    hosts = [f"h{i}.{tlds[i % 6]}" for i in range(120)]
    rows = [(i, f"http://{hosts[i % 120]}p{i}", "".join(f'<a href="https://{hosts[j].split("/")[0].upper()}/x">' for j in rng.integers(0, 120, rng.integers(0, 4)))) for i in range(300)] + [(301, None, None), (302, "nothing", '<a href="//h1.net">'), (5, "http://h5.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, c.execute(f"select {', '.join(cols)} from ({urls.op10_sql()})").fetchall()))
    got = sorted(str(tuple(r)) for r in urls.judge(pages).select(*cols).collect())
    assert got == want and sum("block" in r and "None, 'block'" in r for r in got) > 5
    assert urls.judge(pages.where("page_id < 0")).count() == 0 and urls.judge(pages.union(pages)).count() == 606


# ---- search


def test_cuts_cover_the_code():
    for n in (0, 1, 500, 10**5, 10**6, 10**12):
        at = topk.cuts(n)
        assert [a for a, _ in at] == [sum(w for _, w in at[:i]) for i in range(len(at))] and sum(w for _, w in at) == 64 and all(8 <= w <= 16 for _, w in at)


@pytest.mark.parametrize("n, held, at", [(30, 1, None), (700, 7, topk.cuts(1 << 20)), (3000, 1 << 14, None)])
def test_search_equals_comparison(spark, n, held, at):
    """Segments of 8 to 11 bits, results handed on early, crowded codes."""
    rng = np.random.default_rng(n)
    codes = (rng.integers(-(1 << 62), 1 << 62, n // 10 + 1)[rng.integers(0, n // 10 + 1, n)] ^ (1 << rng.integers(0, 62, n)) * (rng.random(n) < 0.7)).tolist()
    rows = spark.createDataFrame(list(enumerate(codes)) + [(0, codes[0])], "id long, code long")
    got = {(r["query_id"], r["rank"]): (r["distance"], r["neighbor_id"]) for r in topk.search(rows, rows.where("id % 50 = 0"), held=held, at=at).collect()}
    x = np.array(codes)
    for q in range(0, n, 50):
        d = np.bitwise_count((x ^ x[q]).view(np.uint64))
        want = sorted(zip(d.tolist(), range(n)))[:10]
        assert [got[q, k + 1] for k in range(len(want))] == want


def test_vectors_without_a_code(spark):
    v = [1.0] * 64
    rows = [(1, v), (2, None), (3, [1.0] * 63), (4, [1.0] * 65), (None, v), (5, [None] + [1.0] * 63), (50, v), (50, v)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code")).where("code is not null and id is not null")
    got = sorted((r["query_id"], r["neighbor_id"], r["distance"]) for r in topk.search(made, made.where("id % 50 = 0")).collect())
    assert got == [(50, 1, 0), (50, 5, 1), (50, 50, 0)]


def test_rounds_keep_one_table(spark):
    import glob

    from wiregaze.llm import common

    tables = lambda name: set(glob.glob(f"{common.scratch_dir(spark).removeprefix('file://')}/wiregaze/{name}-*"))
    kept = {n: tables(n) for n in ("stars", "rank")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    roots = common.connected_components(chain)
    ring = spark.createDataFrame([("t", str(i), str((i + 1) % 9), 1) for i in range(9)], "side string, src string, dst string, weight long")
    seeds = spark.createDataFrame([("t", str(i), float(i == 0)) for i in range(9)], "side string, host string, seed double")
    scores = urls.spread(seeds, ring, tolerance=0.2)
    assert all(len(tables(n) - kept[n]) == 1 for n in kept)
    assert {r["root"] for r in roots.collect()} == {0} and scores.count() == 9
