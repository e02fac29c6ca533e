import json

import pytest
from pyspark.sql import functions as F

from wiregaze.operators import bayes, bloom, kmeans, knn, zscore
from wiregaze.operators.evaluate import overlap, rebalance, split
from wiregaze.plans import models
from wiregaze.sources import tabular


def cm(df):
    r = df.first()
    return r["tp"], r["fp"], r["fn"], r["tn"]


def test_published_knn_matrix(spark, fixtures):
    assert cm(models.evaluate_knn(tabular.load_knn_csv(spark, f"{fixtures}/knn.csv"))) == (21, 0, 0, 19)


def test_published_payload_matrix(spark, fixtures):
    got = models.evaluate_payload(tabular.load_payload_csv(spark, f"{fixtures}/payload.csv")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (11, 0, 1, 12)
    assert (got["f1"], got["mcc"]) == (0.9565, 0.9199)


@pytest.mark.parametrize("guard, expected", [(True, (6, 0, 0, 34)), (False, (3, 0, 3, 34))])
def test_published_zscore_matrices(spark, fixtures, guard, expected):
    assert cm(models.evaluate_zscore(tabular.load_zscore_csv(spark, f"{fixtures}/zscore.csv"), guard)) == expected


def test_published_kmeans_matrix(spark, fixtures):
    assert cm(models.evaluate_kmeans(tabular.load_kmeans_csv(spark, f"{fixtures}/kmeans.csv"))) == (8, 0, 0, 36)


def test_published_bloom_matrix(spark, fixtures):
    got = models.evaluate_bloom(tabular.load_bloom_csv(spark, f"{fixtures}/bloom.csv"))
    assert cm(got["scores"]) == (5, 0, 0, 20)
    assert got["saturation"] == 0.015 and got["leaked"] == 0 and got["held_out"] == 5


def test_guarded_flood_and_ceiling():
    base = [10, 12, 11, 10, 13, 9, 11, 12, 10, 11]
    got = list(zscore.fold_rows(base + [8000] * 60, window=10, min_pps=0))
    assert sum(r[4] for r in got) == 60
    naive = list(zscore.fold_rows(base + [8000] * 60, window=10, min_pps=0, guard=False))
    assert sum(r[4] for r in naive) < 5


def test_low_spike_is_admitted():
    f = zscore.Guarded(window=30, min_pps=500)
    for x in [10, 12, 11, 10, 13, 9, 11, 12, 10, 11]:
        f.step(x)
    r = f.step(75)
    assert r[3] and not r[4] and f.history[-1] == 75


def test_persistence():
    f = zscore.Guarded(persist=3)
    for x in [10, 12, 11, 10, 13, 9, 11, 12]:
        f.step(x)
    assert [f.step(8000)[6:8] for _ in range(4)] == [(False, False), (False, False), (True, True), (True, False)]


def test_sql_fold_equals_python_fold(spark):
    rows = [(i // 60, i, float((i * 37) % 23 + (900 if i % 17 == 0 else 0))) for i in range(240)]
    df = spark.createDataFrame(rows, "s int, t long, x double")
    a = {(r["s"], r["t"]): (round(r["z"], 6), r["candidate"]) for r in zscore.guarded_sql_fold(df, "t", "x", "s", min_pps=0.0).collect()}
    b = {(r["s"], r["t"]): (round(r["z"], 6), r["candidate"]) for r in zscore.guarded(df, "t", "x", "s", min_pps=0.0).collect()}
    assert a == b


def test_naive_window_equals_fold(spark):
    rows = [(0, i, float((i * 37) % 23 + (900 if i % 17 == 0 else 0))) for i in range(150)]
    df = spark.createDataFrame(rows, "s int, t long, x double")
    a = [(r["t"], round(r["z"], 6), r["candidate"], r["streak"]) for r in zscore.naive(df, "t", "x", ["s"], min_pps=0.0).orderBy("t").collect()]
    b = [(i, round(r[2], 6), r[4], r[5]) for i, r in enumerate(zscore.fold_rows([x for _, _, x in rows], min_pps=0.0, guard=False))]
    assert a == b


@pytest.mark.parametrize("points, label", [([(1, 5), (2, 12), (12, 75), (25, 150), (27, 160), (1, 1500), (1, 15000)], "Normal"), ([(45, 50), (200, 200), (400, 800), (20, 30), (12, 18), (30, 40)], "Scan")])
def test_knn_cases(spark, points, label):
    df = spark.createDataFrame(points, "unique_ports long, packets long")
    assert {r["label"] for r in knn.classify(df, knn.seed(spark)).collect()} == {label}


def test_knn_sanitise(spark):
    rows = spark.createDataFrame([(0, "0", "50", "Scan"), (1, "x", "5", "Scan"), (2, "9", "3", "Normal"), (3, "30", "40", " scan ")], "row_no long, unique_ports string, packet_count string, label string")
    assert [(r["row_no"], r["label"], r["corrected"]) for r in knn.sanitise(rows).orderBy("row_no").collect()] == [(0, "Normal", True), (3, "Scan", False)]


def test_novelty_flags_and_learns_nothing():
    f = kmeans.Novelty()
    for i in range(25):
        f.step(10 + i % 3, 2)
    before = json.dumps(f.to_dict())
    assert all(f.step(*p)[4] for p in [(9000, 1), (60, 45), (300, 400)])
    assert json.dumps(f.to_dict()) == before


def test_admin_alone_stays_safe(spark):
    vocab = spark.createDataFrame([(0, "ADMIN", 0.99, 0.01)], "ord int, word string, p_mal double, p_safe double")
    r = bayes.score(spark.createDataFrame([("GET /admin",)], "p string"), "p", vocab, (0.5, 0.5)).first()
    assert r["confidence"] > 0.8 and r["verdict"] == "Safe"


def test_invalid_utf8_is_left_out(spark):
    r = bayes.score(spark.createDataFrame([(bytearray(b"UN\xffION SELECT"),)], "p binary"), "p").first()
    assert r["keywords"] == ["UNION", "SELECT"]


def test_feed(spark):
    df = spark.createDataFrame([("# c",), ("",), ("1.2.3.4 # x",), ("5.6.7.8,note",), ("9.9.9.9",)], "value string")
    assert [r[0] for r in tabular.parse_feed(df).collect()] == ["1.2.3.4", "5.6.7.8", "9.9.9.9"]


def test_bloom_hex_round_trip():
    assert bloom.from_hex(bloom.to_hex([0, 9, 302, 999])) == [0, 9, 302, 999]
    assert bloom.from_hex("zz") is None


def test_brain_round_trip(spark, fixtures, tmp_path):
    from wiregaze.sources.sinks import latest_brain, write_brain

    rows = {k: getattr(tabular, f"load_{k}_csv")(spark, f"{fixtures}/{k}.csv") for k in ("knn", "payload", "kmeans", "zscore", "bloom")}
    brain = models.train_brain(*[rows[k] for k in ("knn", "payload", "kmeans", "zscore", "bloom")])
    write_brain(brain, str(tmp_path / "brain"))
    again = latest_brain(str(tmp_path / "brain"))
    assert again == json.loads(json.dumps(brain))
    assert cm(models.evaluate_kmeans(rows["kmeans"], again["kmeans"]))[0] == 8


def test_split_sizes(spark, fixtures):
    rows = tabular.read_csv(spark, f"{fixtures}/bloom.csv")
    got = split(rows, ["ip", "label"], "label", "stage-seed", "bloom_sample.csv")
    assert {(r["split"], r["label"]): r["count"] for r in got.groupBy("split", "label").count().collect()} == {("train", "Malicious"): 7, ("train", "Normal"): 14, ("validation", "Malicious"): 1, ("validation", "Normal"): 3, ("test", "Malicious"): 2, ("test", "Normal"): 3}
    assert overlap(got, ["ip", "label"]).count() == 0


def test_rebalance_repeats_the_warm_up(spark):
    df = spark.range(1000).select(F.col("id").alias("row_no"), (F.col("id") % 10).alias("pps"), F.when(F.col("id") < 500, "Normal").otherwise("DDoS").alias("label"))
    got = rebalance(df, "row_no")
    assert got.where("part = 0").count() == 30 and got.where("part = 1 and label = 'DDoS'").count() == 26 and got.count() == 30 + 500 + 26


def test_loader_errors(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("unique_ports,label\n1,Normal\n")
    with pytest.raises(tabular.DatasetError):
        tabular.load_knn_csv(spark, str(p))
    p.write_text("unique_ports,packet_count,label\nx,2,Normal\n")
    with pytest.raises(Exception, match="bad unique_ports"):
        tabular.load_knn_csv(spark, str(p)).collect()


def test_flow_labels(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("unique_ports,Tot Fwd Pkts,Label\n3,9,DDoS-ICMP_Flood\n20,40,Recon-PortScan\n1,5,Benign\nx,1,Benign\n9,3,Benign\n")
    a, b = tabular.load_flows(spark, str(p))
    assert [r["label"] for r in a.orderBy("row_no").collect()] == ["Normal", "Scan", "Normal"] and b.count() == 3
