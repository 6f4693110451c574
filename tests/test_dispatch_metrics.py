import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridtide.operators import backtest, dispatch, metrics


def greedy_off(hours, loss, forced, cost, need):
    """The scan written out: blocks of adjacent free hours, best end per start."""
    free, off, i = [h for h in hours if h not in forced], set(forced), 0
    while i < len(free):
        if loss[free[i]] <= 0:
            i += 1
            continue
        best, best_end, total = 0.0, -1, 0.0
        for j in range(i, len(free)):
            if j > i and free[j] != free[j - 1] + 1:
                break
            total += loss[free[j]]
            if total - cost > best and j - i + 1 >= need:
                best, best_end = total - cost, j
        if best_end >= 0:
            off |= set(free[i : best_end + 1])
            i = best_end + 1
        else:
            i += 1
    return off


def test_curtailment_equals_greedy_scan(spark):
    rng = np.random.default_rng(4)
    rows = []
    for day in range(120):
        price = np.round(rng.gamma(2.0, 25.0, 24), 2)
        prob = rng.random(24) * 0.78
        for h in range(24):
            rows.append((day, h + 1, float(price[h]), float(prob[h]), bool(rng.random() < 0.03), str(rng.choice(["discharge", "idle", "charge"]))))
    pdf = pd.DataFrame(rows, columns=["day", "hour", "price", "spike_prob", "is_spike", "bess_action"])
    got = dispatch.curtailment_schedule(spark.createDataFrame(pdf), ["day"]).toPandas()
    for day, g in pdf.groupby("day"):
        loss = {r.hour: max(0.0, r.price - 55) for r in g.itertuples()}
        forced = {r.hour for r in g.itertuples() if r.spike_prob >= 0.7 or r.is_spike or (r.bess_action == "discharge" and loss[r.hour] > 0)}
        want = greedy_off(sorted(loss), loss, forced, 40.0, 2)
        mine = got[(got["day"] == day) & (got["action"] == "OFF")]["hour"]
        assert set(mine) == want


def test_battery_rule_stays_in_bounds(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"p": "x", "hour": np.arange(24), "price": rng.random(24) * 100})
    out = dispatch.battery_rule_schedule(spark.createDataFrame(pdf), ["p"], "hour", "price").toPandas().sort_values("hour")
    assert out["soc"].between(0.1, 0.9).all() and len(out) == 24
    lo, hi = np.quantile(pdf["price"], [0.3, 0.7])
    assert (out.loc[out["ch"] > 0, "price"] <= lo).all() and (out.loc[out["dis"] > 0, "price"] >= hi).all()


def test_interpolation_holds_the_last_value(spark):
    pdf = pd.DataFrame({"d": "x", "hour": np.arange(24), "price": np.arange(24.0)})
    out = dispatch.interpolate_to_5min(spark.createDataFrame(pdf), ["d"], "hour", "price").toPandas().sort_values("slot")
    np.testing.assert_allclose(out["price"], np.interp(np.arange(288) / 12, np.arange(24), np.arange(24.0)))


def test_error_metrics_fixture(spark):
    pdf = pd.DataFrame({"k": 1, "actual": [40.0, 37.5, 40.0, 50.0], "pred": [42.0, 34.5, 41.0, 49.0]})
    r = metrics.error_metrics(spark.createDataFrame(pdf), ["k"]).first()
    assert abs(r.mae - 1.75) < 1e-9 and abs(r.rmse - 3.75**0.5) < 1e-9 and r.n == 4


def test_risk_fixture(spark):
    pdf = pd.DataFrame({"k": "x", "d": pd.date_range("2026-01-01", periods=10).date, "pnl": [50.0, -20.0] * 5})
    r = backtest.risk_metrics(spark.createDataFrame(pdf), "k", "d", "pnl").first()
    assert (r.total_pnl, r.win_rate, r.max_drawdown, r.best_day, r.worst_day) == (150.0, 0.5, -20.0, 50.0, -20.0)


def test_auc_with_ties_against_pairs(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    r = metrics.roc_pr_auc(df, [], "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(r.roc_auc - want) < 1e-12
    one = metrics.roc_pr_auc(df.withColumn("y", F.lit(1)), [], "y", "p").first()
    assert one.roc_auc is None and one.pr_auc is None


def test_always_long_and_short_mirror(spark):
    rng = np.random.default_rng(9)
    t = pd.date_range("2025-01-01", periods=100, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"t": t, "day": t.date, "spread": rng.normal(0, 5, 100)}))
    tr = backtest.apply_strategies(df, {"long": F.lit(1), "short": F.lit(-1), "none": F.lit(0)}, "spread")
    m = {r.strategy: r for r in backtest.backtest_metrics(tr, "strategy", "day", F.col("day"), [F.col("t")]).collect()}
    assert abs(m["long"].total_pnl + m["short"].total_pnl) < 1e-9
    assert m["none"].total_trades == 0 and m["none"].max_drawdown == 0
