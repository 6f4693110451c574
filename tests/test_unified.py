import numpy as np
import pandas as pd
import pytest

from gridtide.plans import unified


def hourly(start, days, skip=(), value=lambda i: float(i)):
    rows, i = [], 0
    for d in pd.date_range(start, periods=days):
        for he in [24, *range(1, 24)]:  # hour 24 opens the date
            if (d.strftime("%Y-%m-%d"), he) not in skip:
                rows.append((d.date(), he, value(i)))
            i += 1
    return pd.DataFrame(rows, columns=["delivery_date", "hour_ending", "lmp"])


def build(spark, pdf, **kw):
    rtm = spark.createDataFrame(pdf.assign(point="z", lmp=pdf["lmp"] / 2))
    out = unified.unified_features(spark.createDataFrame(pdf), rtm, ["point"], **kw)
    return out.toPandas().assign(_h=lambda x: x["hour_ending"] % 24).sort_values(["delivery_date", "_h"]).drop(columns="_h").reset_index(drop=True)


def test_columns_and_identities(spark):
    out = build(spark, hourly("2024-01-01", 10))
    assert len(unified.FEATURES) == 80
    assert list(out.columns) == ["point", "delivery_date", "hour_ending", *unified.FEATURES, *unified.TARGETS]
    assert len(out) == 72  # 168 rows of history, and the frame before the current row
    np.testing.assert_allclose(out["dam_lag_24h"], out["dam_lmp"] - 24)
    np.testing.assert_allclose(out["dam_roll_24h_mean"], out["dam_lmp"] - 12.5)
    np.testing.assert_allclose(out["dam_rtm_spread"], out["dam_lag_1h"] - out["rtm_lag_1h"])


def test_gap_keeps_true_time(spark):
    out = build(spark, hourly("2024-01-01", 20, skip={("2024-01-02", 3)}))
    assert len(out) < 20 * 24 - 168
    np.testing.assert_allclose(out["dam_lag_24h"], out["dam_lmp"] - 24)


def test_spring_hour_is_not_made_up(spark):
    pdf = hourly("2024-03-01", 20, skip={("2024-03-10", 2)})
    out = build(spark, pdf)
    day = out[out["delivery_date"] == pd.Timestamp("2024-03-10").date()]
    assert 2 not in set(day["hour_ending"]) and len(day) == 23


def test_duplicate_source_rows_do_not_multiply(spark):
    pdf = hourly("2024-01-01", 10)
    fuel = pdf[["delivery_date", "hour_ending"]].assign(**{c: 10.0 for c in unified.FUEL_PCT})
    fuel = spark.createDataFrame(pd.concat([fuel, fuel.assign(wind_pct=20.0)]))
    out = build(spark, pdf, fuel_pct=fuel)
    assert len(out) == 72 and set(out["wind_pct"]) == {15.0}


@pytest.mark.parametrize("cut", [200])
def test_future_does_not_change_past(spark, cut):
    a = hourly("2024-01-01", 12)
    b = a.copy()
    b.loc[cut:, "lmp"] += 500
    x, y = build(spark, a), build(spark, b)
    n = cut - 168
    pd.testing.assert_frame_equal(x.iloc[:n].drop(columns=unified.TARGETS), y.iloc[:n].drop(columns=unified.TARGETS))
