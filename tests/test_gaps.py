"""Functions that no query runs: loaders, sinks, model import, the detectors' contract, streams and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from wiregaze.__main__ import drift, main
from wiregaze.functions import frames
from wiregaze.operators import alerts, bayes, bloom, detectors, evaluate, kmeans, knn, zscore
from wiregaze.plans.replay import scenario
from wiregaze.sources import pcap, sinks, tabular
from wiregaze.streaming import live


def test_training_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"knn": [["12", "30", "portscan"], [3, 9, "benign"]], "payload": [{"payload": "x", "label": "sqli"}], "kmeans": [[4.5, 2]]}))
    got = tabular.load_training_json(spark, str(path))
    assert [tuple(r) for r in got["knn"].orderBy("row_no").collect()] == [(0, 12, 30, "Scan"), (1, 3, 9, "Normal")]
    assert got["payload"].first()["label"] == "Malicious" and tuple(got["kmeans"].first())[1:] == (4.5, 2.0)


def test_raw_labels(spark, tmp_path):
    (tmp_path / "z.csv").write_text("pps,label\n5.9, DDoS \n7,x\n")
    got = tabular.load_zscore_csv(spark, str(tmp_path / "z.csv"), raw_labels=True).orderBy("row_no").collect()
    assert [(r["pps"], r["label"]) for r in got] == [(5.0, "DDoS"), (7.0, "x")]
    (tmp_path / "b.csv").write_text("ip,label\n1.2.3.4, Evil \n,x\n")
    got = tabular.load_bloom_csv(spark, str(tmp_path / "b.csv"), raw_labels=True).collect()
    assert [(r["ip"], r["label"]) for r in got] == [("1.2.3.4", "Evil")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, "10.0.0.1", "zscore", "DDoS DETECTED!", 0.5), (2.0, "10.0.0.2", "knn", 'PORT "SCAN"', None)], "t double, src string, engine string, message string, confidence double").withColumn("ts", F.timestamp_seconds("t"))
    path = str(tmp_path / "audit")
    sinks.write_audit(rows, path)
    sinks.write_audit(rows, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    assert tuple(back.columns) == sinks.AUDIT_COLUMNS and back.count() == 4
    assert {(r["Confidence"], r["Message"]) for r in back.collect()} == {("0.5000", "DDoS DETECTED!"), (None, 'PORT "SCAN"')}
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.csv").write_text("x,y\n1,2\n")
    sinks.write_audit(rows, str(tmp_path / "old"))
    assert len(list(tmp_path.glob("old.legacy_*"))) == 1 and spark.read.csv(str(tmp_path / "old"), header=True).count() == 2
    assert sinks.write_report(rows, str(tmp_path / "r.html")) and "&quot;SCAN&quot;" in (tmp_path / "r.html").read_text()
    assert not sinks.write_report(rows.where("t < 0"), str(tmp_path / "none.html")) and not (tmp_path / "none.html").exists()
    sinks.export_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    for v in (1, 2):
        spark.range(v).withColumn("version", F.lit(v)).write.mode("append").partitionBy("version").parquet(str(tmp_path / "model"))
    assert sinks.read_latest_version(spark, str(tmp_path / "model")).count() == 2


def test_model_import(spark):
    good = knn.from_brain(spark, {"training_data": [[12, 30, "scan"], ["x", 1, "scan"], [50, 10, "scan"], [2, 9, "weird"], [1]]})
    assert [(r["unique_ports"], r["label"]) for r in good.orderBy("row_no").collect()] == [(12.0, "Scan"), (2.0, "Normal")]
    for bad in ({}, {"training_data": []}, {"training_data": [["x", "y", "z"]]}):
        assert knn.from_brain(spark, bad).count() == knn.seed(spark).count()
    vocab, priors = bayes.from_brain(spark, {"prior_malicious": "0.2", "likelihoods": {"union": [0.5, 0.1], "zero": [0, 0.1], "bad": ["x", 1], "short": [1]}})
    assert [(r["word"], r["p_mal"]) for r in vocab.collect()] == [("UNION", 0.5)] and priors[0] == 0.2
    assert bayes.from_brain(spark, {"likelihoods": 3})[0].count() == bayes.vocabulary(spark).count()
    fp = bloom.verdict(F.lit(True), 0.25)
    assert tuple(spark.range(1).select(fp.alias("v")).first()["v"]) == ("Blacklisted", 0.75)


def test_z_of_changes_nothing():
    fold = zscore.Guarded()
    for x in (1, 2, 3, 4, 5, 6):
        fold.step(float(x))
    before = fold.to_json()
    assert round(fold.z_of(10.0), 6) == round((10 - 3.5) / (35 / 12) ** 0.5, 6) and fold.to_json() == before and zscore.Guarded().z_of(5.0) == 0.0


def test_verdict_detail_counts_the_baseline_after_the_update(spark):
    df = spark.createDataFrame([(0, i, float(100 + i % 3)) for i in range(8)] + [(0, 8, 900.0)], "series int, second int, pps double")
    got = zscore.detail(zscore.guarded(df, "second", "pps", "series"), "pps").orderBy("second").collect()
    assert [r["detail"]["baseline_samples"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert got[-1]["detail"]["volume_candidate"] and got[-1]["detail"]["z_score"] == round(got[-1]["z"], 4) and got[-1]["detail"]["mean"] == round(got[-1]["mean"], 2)


def test_plain_cluster_step_always_learns():
    fold = kmeans.Novelty()
    k, _ = fold.nearest(50.0, 4.0)
    before = list(fold.centroids[k])
    assert fold.classify(50.0, 4.0) == k and fold.n == 0
    assert fold.centroids[k] == [before[0] + 0.05 * (50 - before[0]), before[1] + 0.05 * (4 - before[1])]


def test_equal_times_publish_the_first_by_number(spark):
    rows = spark.createDataFrame([(i, 0.0, "ddos", "a", "m") for i in (5, 3, 9)], "seq long, t double, kind string, src string, message string").repartition(3)
    assert [r["seq"] for r in alerts.dedup(rows).where("published").collect()] == [3]


def test_training_for_neighbours_is_bounded(spark):
    rows = spark.range(knn.MAX_TRAINING * 3).select(F.col("id").alias("row_no"), (F.col("id") % 40 + 10).alias("unique_ports"), (F.col("id") % 40 + 15).alias("packet_count"), F.when(F.col("id") % 2 == 0, "Scan").otherwise("Normal").alias("label"))
    assert len(knn.model(rows).first()["rows"]) <= knn.MAX_TRAINING


def test_detectors_keep_one_contract(spark):
    series = spark.createDataFrame([(0, i, float(10 + i % 4), float(3 + i % 2), "Normal") for i in range(40)], "series int, second int, pps double, unique_ports double, label string")
    tables = {
        "z_score": (series, series), "kmeans": (series, series),
        "knn": (spark.createDataFrame([(1, "20", "30", "scan"), (2, "2", "90", "x"), (3, "40", "60", "scan")], "row_no long, unique_ports string, packet_count string, label string"), spark.createDataFrame([(20, 30), (1, 90)], "unique_ports long, packets long")),
        "naive_bayes": (spark.createDataFrame([("union select", "Malicious")] * 3 + [("hello there", "Normal")] * 3, "payload string, label string"), spark.createDataFrame([("a union select b",), ("hello",)], "payload string")),
        "bloom": (spark.createDataFrame([("1.1.1.1", "bad"), ("2.2.2.2", "safe")], "ip string, label string"), spark.createDataFrame([("1.1.1.1",), ("3.3.3.3",)], "ip string")),
    }
    for name, d in detectors.detectors().items():
        train, seen = tables[name]
        shown = lambda x: sorted(map(str, (r["verdict"].asDict() for r in x.score(seen).collect())))
        cold = shown(d)
        fitted = shown(d.fit(train))
        brain = json.loads(json.dumps(d.to_brain()))
        assert all({"label", "confidence", "is_threat"} == set(r["verdict"].asDict()) for r in d.score(seen).collect())
        assert shown(d.reset()) == cold and shown(d.from_brain(spark, brain)) == fitted


def test_report_marks_scores_no_better_than_guessing(spark):
    cm = spark.createDataFrame([("good", 10, 0, 0, 10), ("poor", 1, 5, 9, 5)], "engine string, tp long, fp long, fn long, tn long")
    got = {r["engine"]: r for r in evaluate.report(evaluate.scores(cm)).collect()}
    assert not got["good"]["no_better_than_guessing"] and got["poor"]["no_better_than_guessing"]
    assert "F1: 1.0000" in got["good"]["report"] and "no-skill baseline" in got["poor"]["report"]


def test_sensors_online(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 95.0), ("b", 40.0), ("c", 40.1)], "sensor string, t double")
    assert alerts.sensors_online(rows, 100.0).first()[0] == 2


def test_snapshots_become_frames(spark):
    rows = spark.createDataFrame([("45000014", 5.5, 60), ("zz", 6.0, 1), (None, 7.0, 1), ("450", 8.0, 1)], "hex string, ts double, length int")
    got = pcap.frames_of_snapshots(rows).collect()
    assert [(r["ts_us"], bytes(r["raw"]), r["orig_len"]) for r in got] == [(5_500_000, bytes.fromhex("45000014"), 60)]


def test_streams(spark, tmp_path):
    us = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 100_000)
    rows = spark.range(40).select(us.alias("ts"), (F.col("id") % 5).cast("int").alias("dport"), F.lit(False).alias("bl_hit"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = live.limited(spark, str(tmp_path / "in"), "ts timestamp, dport int, bl_hit boolean", files=1)
    q = live.publish(live.interval_features(stream, late="1 minute"), "features", every=None, mode="complete")
    q.awaitTermination()
    got = spark.table("features").orderBy("start").collect()
    assert [(r["pps"], r["unique_ports"]) for r in got] == [(10, 4)] * 4 and len(q.recentProgress) >= 4
    sink = {"a": 0, "b": 0}
    fans = [lambda b, e, k=k: sink.__setitem__(k, sink[k] + b.count()) for k in sink]
    live.fan_out(live.limited(spark, str(tmp_path / "in"), "ts timestamp, dport int, bl_hit boolean"), fans, str(tmp_path / "state")).awaitTermination()
    assert sink == {"a": 40, "b": 40}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "z.csv").write_text("pps,label\n" + "".join(f"{10 + i % 4},normal\n" for i in range(30)) + "900,ddos\n")
    assert main(["train", "--zscore", str(tmp_path / "z.csv"), "--out", str(tmp_path / "brain")], spark) == 0
    brain = sinks.latest_brain(str(tmp_path / "brain"))
    assert brain["z_score"]["count"] == 30 and main(["evaluate", "--zscore", str(tmp_path / "z.csv")], spark) == 0
    assert "--- zscore ---" in capsys.readouterr().out and main(["evaluate"], spark) == 2
    assert drift([{"kmeans": {"centroids": [[1, 2]]}}, {}, {"kmeans": {"centroids": [[3, 4]]}}]) == [(0, 0, 1.0, 2.0), (2, 0, 3.0, 4.0)]
    from wiregaze.plans.workspace import capture_file

    assert main(["replay", capture_file(scenario(spark).orderBy("no").limit(200))], spark) == 0
    assert frames.decode is not None and "engine" in capsys.readouterr().out


@pytest.mark.parametrize("bad", [["nothing"], []])
def test_command_line_refuses(bad):
    with pytest.raises(SystemExit):
        main(bad)
