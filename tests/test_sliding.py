import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridtide.operators import sliding as sl


def brute(x, day, i, rows, shift):
    a = x[max(0, i - shift - rows + 1) : max(0, i - shift + 1)]
    return a[~np.isnan(a)]


def test_statistics_over_many_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 900
    made = {}
    for key in ("a", "b"):
        x = np.round(rng.normal(0, 2, n), 1) + (1e7 if key == "b" else 0)
        x[rng.random(n) < 0.1] = np.nan
        made[key] = x
    t = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = pd.concat([pd.DataFrame({"key": k, "t": t, "d": t.date, "v": v, "more": "x"}) for k, v in made.items()])
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(3)
    stats = {
        "q": sl.quantile("v", 50, 0.9, need=10), "m": sl.median("v", 30, 4, 15), "n": sl.count("v", 50), "less": sl.below("v", 50), "upto": sl.up_to("v", 50),
        "s": sl.skew("v", 40, 2, 20), "share": sl.share_below_before("v", 48, "d", 25),
    }
    out = sl.sliding(df, ["key"], "t", stats, rows=130)
    assert out.columns == [*df.columns, *stats] and dict(out.dtypes)["t"] == "timestamp" and dict(out.dtypes)["n"] == "bigint"
    got = out.toPandas().sort_values(["key", "t"])
    for key, x in made.items():
        g = got[got["key"] == key].reset_index(drop=True)
        assert len(g) == n and isinstance(g["d"][0], datetime.date)
        for i in range(n):
            own, mid, late = brute(x, None, i, 50, 0), brute(x, None, i, 30, 4), brute(x, None, i, 40, 2)
            row = g.loc[i]
            want = [
                np.quantile(own, 0.9) if len(own) >= 10 else np.nan, np.median(mid) if len(mid) >= 15 else np.nan, len(own),
                (own < x[i]).sum() if x[i] == x[i] else np.nan, (own <= x[i]).sum() if x[i] == x[i] else np.nan, pd.Series(late - np.nanmean(x)).skew() if len(late) >= 20 else np.nan,
            ]
            np.testing.assert_allclose([row.q, row.m, row.n, row.less, row.upto, row.s], want, rtol=1e-9, atol=1e-6)
            start = i - i % 24
            before = x[max(0, start - 48) : start]
            before = before[~np.isnan(before)]
            np.testing.assert_allclose(row.share, (before < x[i]).mean() if len(before) else np.nan)


def test_flat_short_and_empty_series(spark):
    df = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, h), 5.0) for h in range(5)], "key string, t timestamp, v double")
    rows = sl.sliding(df, ["key"], "t", {"s": sl.skew("v", 4), "m": sl.median("v", 3, need=3)}).orderBy("t").collect()
    assert [r.s for r in rows] == [None] * 5 and [r.m for r in rows] == [None, None, 5.0, 5.0, 5.0]
    assert sl.sliding(df.limit(0), ["key"], "t", {"m": sl.median("v", 3)}).count() == 0
