"""Chunked scans against pandas on a table where one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridtide.operators import align, backtest, ranked


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 4000
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(400_000, n, replace=False)), unit="s")
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    v = np.round(rng.normal(0, 10, n), 2)
    return pd.DataFrame({"key": key, "t": t, "v": v, "id": np.arange(n)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def test_prefix_scan(spark, skewed):
    df = frame(spark, skewed).withColumn("w", F.when(F.col("v") > 5, F.col("v")))
    out = ranked.prefix_scan(
        df, ["key"], F.date_trunc("hour", "t"), [F.col("t")], sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("w")}
    ).toPandas().sort_values("id")
    g = skewed.groupby("key")["v"]
    np.testing.assert_allclose(out["s"], g.cumsum().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(out["m"], g.cummax().to_numpy())
    want = skewed.assign(w=skewed["v"].where(skewed["v"] > 5)).groupby("key")["w"].ffill().to_numpy()
    np.testing.assert_allclose(out["l"].astype(float), want)


def test_descending_scan_and_splits(spark, skewed):
    df = frame(spark, skewed)
    out = ranked.row_index(df, [], F.floor(F.col("v")), [F.desc("v"), F.col("id")], descending=True).toPandas()
    order = skewed.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert out.sort_values("rn")["id"].tolist() == order
    split = ranked.ordered_splits(df, ["key"], F.date_trunc("day", "t"), [F.col("t")], folds=3)
    native = df.withColumn("n", F.ntile(3).over(W.partitionBy("key").orderBy("t")))
    assert split.join(native, "id").filter("fold <> n").count() == 0


@pytest.mark.parametrize("before, after, rows", [(7, 0, 50), (120, 0, 50), (3, 5, 64)])
def test_halo_frames_equal_plain_frames(spark, skewed, before, after, rows):
    df = frame(spark, skewed)
    blocks, w = ranked.with_halo(df, ["key"], F.date_trunc("hour", "t"), [F.col("t")], before, after, rows)
    got = ranked.own_rows(blocks.withColumns({"s": F.sum("v").over(w.rowsBetween(-before, after)), "l": F.lag("v", before).over(w)}))
    plain = W.partitionBy("key").orderBy("t")
    want = df.select("id", F.sum("v").over(plain.rowsBetween(-before, after)).alias("s2"), F.lag("v", before).over(plain).alias("l2"))
    j = got.join(want, "id")
    assert got.count() == len(skewed) and j.count() == len(skewed)
    assert j.filter("abs(s - s2) > 1e-9 or not (l <=> l2)").count() == 0


def test_asof_variants_equal_merge_asof(spark, skewed):
    right = skewed.iloc[::7].rename(columns={"v": "r"})[["key", "t", "r"]]
    left = skewed[["key", "t", "id"]]
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="key").sort_values("id")["r"].to_numpy()
    lf, rt = frame(spark, left), frame(spark, right)
    chunked = align.asof_backward(lf, rt, ["key"], "t", ["r"], chunk_minutes=60).toPandas().sort_values("id")["r"]
    whole = align.asof_grid(lf, [(rt, ["r"])], ["key"], "t").toPandas().sort_values("id")["r"]
    np.testing.assert_allclose(chunked.astype(float), want)
    np.testing.assert_allclose(whole.astype(float), want)


def test_drawdown(spark, skewed):
    out = backtest.running_drawdown(frame(spark, skewed), ["key"], F.date_trunc("hour", "t"), [F.col("t")], "v").toPandas().sort_values("id")
    cum = skewed.groupby("key")["v"].cumsum()
    top = cum.groupby(skewed["key"]).cummax()
    np.testing.assert_allclose(out["drawdown"], (cum - top).to_numpy(), atol=1e-9)


def test_exact_quantiles(spark, skewed):
    ps = {"a": 0.05, "b": 0.5, "c": 0.99, "d": 1.0}
    got = ranked.exact_quantiles(frame(spark, skewed), ["key"], "v", ps).toPandas().set_index("key")
    want = skewed.groupby("key")["v"].quantile(list(ps.values())).unstack()
    np.testing.assert_allclose(got.loc[want.index, list(ps)].to_numpy(), want.to_numpy(), atol=1e-9)
