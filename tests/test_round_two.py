"""Folder tables as streams, the keyed sink, ties, NaN and digits, repeated hours, models without lost rows."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridtide.catalog import REGISTRY
from gridtide.functions.frames import exact_mean, long_mean, long_std, series
from gridtide.operators.backtest import trade_log_metrics
from gridtide.plans import daily, learning
from gridtide.sources import sink

SF = "/root/testdata/sf0.001"
STREAMS = sorted(k for k in REGISTRY if k.startswith("stream_"))


@pytest.fixture(scope="module")
def as_folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{d}/{name}")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("key", STREAMS)
def test_stream_reads_folders_and_files(spark, as_folder, key):
    one, many = (sorted(map(str, REGISTRY[key].run(spark, d).collect())) for d in (SF, as_folder))
    assert one == many and one


def test_sink_keeps_partition_text_and_survives_unfinished_writes(spark, folder):
    path = f"{folder}/t"
    batch = spark.createDataFrame([(17, 1, "0017", 5), (18, 1, "x", 6)], "k long, j int, day string, seq int")
    os.makedirs(f"{path}/_temporary/0")  # a first write that did not end
    for _ in range(2):
        sink.upsert_parquet(spark, path, batch, ["k", "j"], "day", "seq")
    back = spark.read.schema(batch.schema).parquet(path)
    assert sorted(map(tuple, back.select("k", "j", "day", "seq").collect())) == [(17, 1, "0017", 5), (18, 1, "x", 6)]
    assert {n for n in os.listdir(path) if n.startswith("day=")} == {"day=0017", "day=x"}


def test_large_partition_value_gets_several_writers(spark, folder, monkeypatch):
    monkeypatch.setattr(sink, "ROWS_PER_FILE", 100)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("p"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # it would join the small parts of this test again
    spark.conf.set(merging, "false")
    sink.export_partitioned(rows, f"{folder}/x", ["p"], salt=F.col("id"))
    spark.conf.set(merging, "true")
    files = {p: len([f for f in os.listdir(f"{folder}/x/p={p}") if f.endswith(".parquet")]) for p in ("hot", "cold")}
    assert spark.read.parquet(f"{folder}/x").count() == 1000 and files["cold"] == 1 and files["hot"] > 1


def test_first_of_equal_drawdowns_counts(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("s", t0 + timedelta(hours=i), 1, v) for i, v in enumerate([10.0, -5.0, 14.5, -5.0])]
    trades = spark.createDataFrame(rows, "strategy string, t timestamp, signal int, pnl double")
    m = trade_log_metrics(trades, "strategy", "t", F.col("t").cast("date"), [F.col("t")], cost=0.0).first()
    assert m["max_drawdown"] == 5.0 and m["max_drawdown_pct"] == 50.0


def test_long_frames_recover_from_nan_and_keep_digits(spark):
    rows = [("a", i, float("nan") if i == 3 else 1e7 + (i % 7) * 0.1) for i in range(3000)]
    w = series("k", "i")
    df = spark.createDataFrame(rows, "k string, i int, v double").select("i", long_mean("v", w, 14, 1).alias("m"), long_std("v", w, 14, 2).alias("s"))
    got = {r["i"]: r for r in df.collect()}
    for i in (2, 10, 50, 2999):
        frame = [v for _, j, v in rows[max(0, i - 13) : i + 1] if v == v]
        mean = sum(frame) / len(frame)
        std = (sum((v - mean) ** 2 for v in frame) / (len(frame) - 1)) ** 0.5
        assert abs(got[i]["m"] - mean) < 1e-6 and abs(got[i]["s"] - std) < 1e-6


def test_sums_keep_input_digits(spark):
    assert spark.createDataFrame([(1.004,), (1.004,)], "v double").agg(exact_mean(F.col("v"))).first()[0] == 1.004


def test_repeated_hour_keeps_the_first_price(spark):
    rows = [("p", "2024-11-03", 2, 10.0, 1), ("p", "2024-11-03", 2, 30.0, 2), ("p", "2024-11-03", 3, 5.0, 3)]
    df = spark.createDataFrame(rows, "k string, d string, h int, v double, o int")
    assert daily.day_arrays(df, ["k"], "d", "h", "v", "o").first()["p"][1] == 10.0
    assert daily.day_arrays(df, ["k"], "d", "h", "v").first()["p"][1:3] == [10.0, 5.0]


def test_models_keep_rows_with_missing_features(spark, folder):
    rows = [(float(i % 5) if i % 4 else None, float(i % 3), float(i % 5 > 2), ["train", "val", "test"][i % 3], "p") for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double, split string, point string")
    model = learning.fit_spike_classifier(df, ["a", "b"], "y", max_iter=5)
    learning.save_model(model, f"{folder}/m")
    learning.save_model(model, f"{folder}/m")
    again = learning.load_model(f"{folder}/m")
    scored = learning.positive_probability(again.transform(df.filter("split = 'test'")))
    assert scored.count() == 100
    cut = learning.best_threshold(learning.positive_probability(model.transform(df.filter("split = 'val'"))), "y")
    assert 0 < cut <= 1
    found = learning.importances(model, spark).collect()
    assert [r["feature"] for r in found] == ["a", "b", "_point"] and abs(sum(r["importance"] for r in found) - 1) < 1e-6
    linear = learning.fit_linear(df, ["a", "b"], "y")
    assert linear.transform(df.filter("split = 'test'")).count() == 100


