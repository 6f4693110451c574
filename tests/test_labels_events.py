import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.operators import events
from gridtide.plans import spike


def zone_hub(spark, zone, hub):
    t = pd.date_range("2024-01-01", periods=len(zone), freq="15min")
    return spark.createDataFrame(pd.DataFrame({"point": "z", "t": t, "lmp": np.asarray(zone, float), "hub": np.asarray(hub, float)}))


def flagged(df, **kw):
    out = spike.spike_events(df, ["point"], "lmp", "hub", **kw).toPandas().sort_values("t").reset_index(drop=True)
    return out.index[out["spike_event"]].tolist()


def test_sustained_spike(spark):
    zone, hub = np.full(100, 30.0), np.full(100, 25.0)
    zone[50:56], hub[50:56] = 500, 50
    assert flagged(zone_hub(spark, zone, hub)) == list(range(50, 56))


def test_single_spike_and_small_spread_are_not_events(spark):
    zone, hub = np.full(100, 30.0), np.full(100, 25.0)
    zone[40] = 500
    assert flagged(zone_hub(spark, zone, hub)) == []
    zone[40:44], hub[40:44] = 500, 490
    assert flagged(zone_hub(spark, zone, hub)) == []


def test_quantile_exceedance(spark):
    rng = np.random.default_rng(1)
    zone, hub = 30 + rng.random(3000), np.full(3000, 25.0)
    zone[-5:] = 200
    assert flagged(zone_hub(spark, zone, hub)) == list(range(2995, 3000))


def test_rank_rule_equals_linear_quantile(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(50, 10, 400), 1)
    df = zone_hub(spark, x, x)
    got = spike.reaches_rolling_quantile(df, ["point"], "t", "lmp", F.lit(True), "f", 0.9, 60, 20).toPandas().sort_values("t")["f"]
    s = pd.Series(x)
    want = (s >= s.rolling(60, min_periods=20).quantile(0.9)).to_numpy()
    assert got.tolist() == want.tolist()


def test_lead_labels(spark):
    df = zone_hub(spark, np.zeros(10), np.zeros(10)).withColumn("e", F.col("t") == F.lit("2024-01-01 01:15:00").cast("timestamp"))
    out = df.withColumns({"x": spike.lead_exclusive("e", ["point"], 4), "i": spike.lead_inclusive("e", ["point"], 4)}).toPandas().sort_values("t")
    assert np.flatnonzero(out["x"]).tolist() == [1, 2, 3, 4]
    assert np.flatnonzero(out["i"]).tolist() == [2, 3, 4, 5]


def test_past_features_ignore_the_future(spark):
    rng = np.random.default_rng(5)
    a = rng.random(300) * 50
    b = a.copy()
    b[200:] += 1000
    w = spike.series("point")
    made = [zone_hub(spark, x, x).select("t", *[c.alias(n) for n, c in spike.price_columns(w).items()]).toPandas().sort_values("t") for x in (a, b)]
    pd.testing.assert_frame_equal(made[0].iloc[:200].reset_index(drop=True), made[1].iloc[:200].reset_index(drop=True))


def brute_ramps(v, threshold, window, direction):
    out, i = [], window
    while i < len(v):
        change = v[i] - v[i - window]
        up, down = change >= threshold, change <= -threshold
        if not {"up": up, "down": down, "both": up or down}[direction]:
            i += 1
            continue
        end = i
        while end + 1 < len(v) and ((down and v[end + 1] < v[end]) or (up and v[end + 1] > v[end])):
            end += 1
        out.append((i - window, end, v[end] - v[i - window] < 0))
        i = end + 1
    return out


def brute_match(true, pred, tol):
    used, hits = set(), 0
    for s, _, d in pred:
        for j, (ts, _, td) in enumerate(true):
            if j not in used and abs(s - ts) <= tol and d == td:
                used.add(j)
                hits += 1
                break
    return hits, len(true) - hits, len(pred) - hits


@pytest.mark.parametrize("direction", ["up", "down", "both"])
def test_ramps_and_matching_against_brute_force(spark, direction):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for key in ("a", "b", "c"):
        truth = np.round(np.cumsum(rng.normal(0, 3, 250)), 1)
        guess = np.round(np.roll(truth, 1) + rng.normal(0, 1, 250), 1)
        found = {}
        for side, v in ((1, truth), (0, guess)):
            found[side] = brute_ramps(v, 7, 3, direction)
            rows += [(key, side, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(x)) for i, x in enumerate(v)]
        want[key] = (found, brute_match(found[1], found[0], 2))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["key", "is_true", "t", "v"]))
    ev = events.ramp_events(df, ["key", "is_true"], "v", 7.0, direction=direction)
    got = ev.toPandas()
    scores = {r.key: (r.hits, r.misses, r.false_alarms) for r in events.match_events(ev, ["key"]).collect()}
    for key, (found, match) in want.items():
        for side in (0, 1):
            g = got[(got["key"] == key) & (got["is_true"] == side)].sort_values("start_i")
            assert list(zip(g["start_i"], g["end_i"], g["is_ramp_down"])) == found[side]
        assert scores[key] == match


@pytest.mark.parametrize("rows, tolerance", [(7, 2), (16, 5), (1, 0)])
def test_matching_composes_over_blocks(spark, rows, tolerance):
    rng = np.random.default_rng(rows)
    made, want = [], {}
    for key in ("a", "b", None):
        sides = [[(int(p), 0, bool(rng.random() < 0.5)) for p in np.flatnonzero(rng.random(300) < 0.6)] for _ in range(2)]
        made += [(key, s, d, side) for side in (0, 1) for s, _, d in sides[side]]
        want[key] = brute_match(sides[1], sides[0], tolerance)
    made.append(("only true", 5, True, 1))
    want["only true"] = (0, 1, 0)
    frame = spark.createDataFrame(made, "key string, start_i int, is_ramp_down boolean, is_true int").repartition(3)
    found = events.match_events(frame, ["key"], tolerance, rows).collect()
    assert {r.key: (r.hits, r.misses, r.false_alarms) for r in found} == want
    assert events.match_events(frame.limit(0), ["key"]).count() == 0


def test_ramps_of_a_dense_series(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.integers(0, 6, 4000), rng.integers(1, 3, 4000)).astype(float)  # plateaus, runs and turning points that all reach the threshold
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": pd.date_range("2024-01-01", periods=len(v), freq="h"), "v": v}))
    for direction in ("up", "down", "both"):
        got = events.ramp_events(df, ["key"], "v", 1.0, window=2, direction=direction).toPandas().sort_values("start_i")
        assert list(zip(got["start_i"], got["end_i"], got["is_ramp_down"])) == brute_ramps(v, 1.0, 2, direction)


def test_sessions_and_recall(spark):
    minutes = [0, 30, 90, 151, 400, 460]
    pdf = pd.DataFrame({"k": "x", "t": [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m) for m in minutes], "p": [0.1, 0.2, 0.3, 0.9, 0.2, 0.4]})
    s = events.sessions(spark.createDataFrame(pdf), ["k"], "t", 60, F.date_trunc("hour", "t"))
    assert s.orderBy("t").toPandas()["event_id"].tolist() == [1, 1, 1, 2, 3, 3]
    r = events.event_recall(s, ["k"], "p", 0.5).first()
    assert (r.n_events, r.events_detected) == (3, 1)
