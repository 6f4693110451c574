"""Spike labels and the 15-minute spike feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.calendar import floor_time, plus_hours, to_local
from ..functions.frames import long_mean, long_std, ratio, rolling, series
from ..operators import align, dedup, fill
from ..operators.ranked import in_blocks
from ..operators.sliding import count, quantile, sliding, up_to

PRICE = ["lmp_lag1", "lmp_lag4", "lmp_lag96", "lmp_mean_4", "lmp_mean_96", "lmp_std_96", "lmp_max_96", "lmp_ramp_1h", "lmp_ramp_4h"]
SPREAD = ["spread_lag1", "spread_mean_4", "spread_max_96", "spread_ramp_1h"]
DAM = ["dam_lmp_current_hour", "dam_rtm_gap"]
WEATHER = ["temp_2m", "wind_speed_10m", "temp_anomaly", "temp_delta_1h", "wind_chill"]
RESERVE = ["prc_lag1", "prc_mean_1h", "prc_ramp_1h", "system_lambda_lag1", "rtordpa_lag1"]
WIND = ["wind_gen_lag1", "wind_forecast_error"]
TEMPORAL = ["hour_of_day", "day_of_week", "month", "is_weekend"]
LABELS = ["spike_event", "lead_spike_60", "regime"]
FEATURES = PRICE + SPREAD + DAM + WEATHER + RESERVE + WIND + TEMPORAL


def price_columns(w, c: str = "lmp") -> dict[str, Column]:
    return {
        "lmp_lag1": F.lag(c, 1).over(w),
        "lmp_lag4": F.lag(c, 4).over(w),
        "lmp_lag96": F.lag(c, 96).over(w),
        "lmp_mean_4": rolling(F.avg, c, w, 4, 1, 1),
        "lmp_mean_96": rolling(F.avg, c, w, 96, 1, 1),
        "lmp_std_96": rolling(F.stddev_samp, c, w, 96, 1, 1),
        "lmp_max_96": rolling(F.max, c, w, 96, 1, 1),
        "lmp_ramp_1h": F.lag(c, 1).over(w) - F.lag(c, 5).over(w),
        "lmp_ramp_4h": F.lag(c, 1).over(w) - F.lag(c, 17).over(w),
    }


def spread_columns(w, c: str = "spread") -> dict[str, Column]:
    return {
        "spread_lag1": F.lag(c, 1).over(w),
        "spread_mean_4": rolling(F.avg, c, w, 4, 1, 1),
        "spread_max_96": rolling(F.max, c, w, 96, 1, 1),
        "spread_ramp_1h": F.lag(c, 1).over(w) - F.lag(c, 5).over(w),
    }


def weather_columns(w, temp: str = "temp", wind: str = "wind") -> dict[str, Column]:
    t, v = F.col(temp), F.col(wind)
    return {
        "temp_2m": t,
        "wind_speed_10m": v,
        "temp_anomaly": t - long_mean(temp, w, 96 * 30, 96),
        "temp_delta_1h": t - F.lag(temp, 4).over(w),
        "wind_chill": rules.wind_chill_metric(t, v),
    }


def reserve_columns(w) -> dict[str, Column]:
    return {
        "prc_lag1": F.lag("prc", 1).over(w),
        "prc_mean_1h": rolling(F.avg, "prc", w, 4, 1, 1),
        "prc_ramp_1h": F.lag("prc", 1).over(w) - F.lag("prc", 5).over(w),
        "system_lambda_lag1": F.lag("lam", 1).over(w),
        "rtordpa_lag1": F.lag("adder", 1).over(w),
    }


def wind_columns(w) -> dict[str, Column]:
    return {"wind_gen_lag1": F.lag("gen", 1).over(w), "wind_forecast_error": F.lag(F.col("gen") - F.col("stwpf"), 1).over(w)}


def feature_matrix(
    rtm: DataFrame, labels: DataFrame, dam: DataFrame, weather: DataFrame, stations: DataFrame, reserves: DataFrame, wind: DataFrame
) -> DataFrame:
    """31 features and 3 labels per (point, 15 minutes), all points in one job.

    rtm (point, t, lmp), labels (point, t, spread, spike_event, lead_spike_60,
    regime), dam (point, t, dam), weather (station, t, temp, wind), stations
    (point, station), reserves (t, prc, lam, adder), wind (t, gen, stwpf).
    """
    base = rtm.join(labels.select("point", "t", "spread", *LABELS), ["point", "t"], "left")
    base = align.asof_grid(base, [(dam, ["dam"])], ["point"], "t")
    base = rules.zone_station(base, stations, "point")
    # system-wide and per-station sources are aligned once per slot, then joined by key
    r15 = dedup.keep_last_non_null(
        reserves.withColumn("q", floor_time(F.col("t"), 15)), ["q"], F.col("t"), ["prc", "lam", "adder"]
    ).withColumnRenamed("q", "t")
    slots = rtm.select("t").distinct()
    system = align.asof_grid(slots, [(r15, ["prc", "lam", "adder"]), (wind, ["gen", "stwpf"])], [], "t")
    late = weather.withColumn("t", plus_hours(F.col("t"), 1))
    local_weather = align.asof_grid(base.select("station", "t").distinct(), [(late, ["temp", "wind"])], ["station"], "t")
    base = base.join(local_weather, ["station", "t"]).join(system, "t")
    w = series("point")
    local = to_local(F.col("t"))
    cols = price_columns(w) | spread_columns(w) | weather_columns(w) | reserve_columns(w) | wind_columns(w)
    cols |= {
        "dam_lmp_current_hour": F.col("dam"),
        "dam_rtm_gap": F.lag(F.col("dam") - F.col("lmp")).over(w),
        "hour_of_day": F.hour(local),
        "day_of_week": F.weekday(local),
        "month": F.month(local),
        "is_weekend": (F.weekday(local) >= 5).cast("int"),
    }
    out = base.select("point", "t", *LABELS, *[c.alias(n) for n, c in cols.items()])
    optional = WEATHER + RESERVE + WIND
    return fill.fill_nullable(out, ["point"], "t", forward=optional, zero=optional)


# --- labels ---------------------------------------------------------------------------------------


def reaches_rolling_quantile(
    df: DataFrame, keys: list[str], t: str, x: str, asked: Column, name: str, p: float, rows: int, min_periods: int
) -> DataFrame:
    """Add ``name``: x is at least the rolling ``p`` quantile (linear) of the last ``rows`` rows, its own included; false where not ``asked``.

    Decided by rank: with n values of which g are larger than x, x reaches the quantile exactly when n - 1 - g >= p (n - 1).
    """
    ranked = sliding(df, keys, t, {"_n": count(x, rows), "_upto": up_to(x, rows)})
    met = (F.col("_n") >= min_periods) & (F.col("_upto") - 1 >= p * (F.col("_n") - 1)) & asked
    return ranked.withColumn(name, F.coalesce(met, F.lit(False))).drop("_n", "_upto")


def run_of_at_least(flag: str, w, keys: list[str], k: int, df: DataFrame) -> DataFrame:
    """Add ``in_run``: the flag holds in a run of at least k consecutive rows (whole run marked)."""
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    ided = df.withColumn("_c", change).withColumn("_id", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count("*").over(W.partitionBy(*keys, "_id"))
    return ided.withColumn("in_run", F.col(flag) & (size >= k)).drop("_c", "_id")


def spike_events(
    df: DataFrame, keys: list[str], price: str, hub: str, p_hi: float = 400.0, s_hi: float = 50.0, min_consecutive: int = 2,
    rows: int = 2880, min_periods: int = 96, p: float = 0.99,
) -> DataFrame:
    """Add raw condition ``raw`` and the sustained ``spike_event``."""
    apart = F.abs(F.col(price) - F.col(hub)) >= s_hi
    ranked = reaches_rolling_quantile(df, keys, "t", price, apart & (F.col(price) < p_hi), "_reached", p, rows, min_periods)
    raw = ((F.col(price) >= p_hi) | F.col("_reached")) & apart
    out = run_of_at_least("raw", series(keys), keys, min_consecutive, ranked.withColumn("raw", raw).drop("_reached"))
    return out.withColumnRenamed("in_run", "spike_event")


def spike_event_trailing(df: DataFrame, keys: list[str], raw: str, m: int) -> Column:
    """The last m rows are all true."""
    return F.sum(F.col(raw).cast("int")).over(series(keys).rowsBetween(-(m - 1), 0)) >= m


def lead_exclusive(event: str, keys: list[str], steps: int) -> Column:
    """Any event in the next ``steps`` rows, the current one excluded."""
    return F.coalesce(F.max(F.col(event).cast("int")).over(series(keys).rowsBetween(1, steps)), F.lit(0))


def lead_inclusive(event: str, keys: list[str], steps: int) -> Column:
    return F.coalesce(F.max(F.col(event).cast("int")).over(series(keys).rowsBetween(0, steps - 1)), F.lit(0))


def market_regime(price: Column, spread: Column, event: Column, p_mid: float = 150.0, s_mid: float = 20.0, signed: bool = False) -> Column:
    gap = spread if signed else F.abs(spread)
    return F.when(event, "Scarcity").when((price >= p_mid) | (gap >= s_mid), "Tight").otherwise("Normal")


def label_points(rtm: DataFrame, hub: DataFrame, horizon_steps: int = 4, **limits) -> DataFrame:
    """All label layers for every point in one job: rtm (point, t, lmp), hub (t, hub)."""
    j = rtm.join(hub, "t").filter("lmp is not null and hub is not null").withColumn("spread", F.col("lmp") - F.col("hub"))
    ev = spike_events(j, ["point"], "lmp", "hub", **limits)
    return ev.withColumns(
        {
            "lead_spike_60": lead_exclusive("spike_event", ["point"], horizon_steps) == 1,
            "regime": market_regime(F.col("lmp"), F.col("spread"), F.col("spike_event")),
        }
    )


def next_hour_spike(price: str, keys: list[str], fixed: float = 100.0, multiple: float = 3.0, rows: int = 24) -> Column:
    """Next price over max(fixed, multiple x trailing mean of earlier rows); NULL on the last row."""
    w = series(keys)
    mean = F.coalesce(rolling(F.avg, price, w, rows, 1, 1), F.lit(0.0))
    nxt = F.lead(price).over(w)
    return F.when(nxt.isNotNull(), (nxt > F.greatest(F.lit(fixed), multiple * mean)).cast("int"))


def regime_features(df: DataFrame) -> DataFrame:
    """Acceleration, volatility regime, momentum, ratio and range from the hourly price features."""
    c = F.col
    mean = c("rtm_roll_24h_mean")
    return df.withColumns(
        {
            "price_accel": (c("rtm_lag_1h") - c("rtm_lag_4h")) - (c("rtm_lag_4h") - c("rtm_lag_24h")),
            "volatility_regime": F.coalesce(ratio(c("rtm_roll_24h_std"), F.abs(mean)), F.lit(0.0)),
            "price_momentum": c("rtm_lag_1h") - mean,
            "price_ratio_to_mean": F.coalesce(ratio(c("rtm_lag_1h"), mean), F.lit(1.0)),
            "rtm_range_24h": c("rtm_roll_24h_max") - c("rtm_roll_24h_min"),
        }
    )


def shift_leaking(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Shift columns that would see the target row by one more row."""
    w = series(keys, order)
    return df.withColumns({c: F.lag(c).over(w) for c in cols})


def price_structure(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spreads, slopes per minute and acceleration from price, hub, dam and other (5-minute rows)."""
    w = series(keys)
    p = F.col("price")
    ramp5 = (p - F.lag("price", 1).over(w)) / 5
    out = df.withColumns(
        {
            "spread_hub": p - F.col("hub"),
            "spread_rt_da": p - F.col("dam"),
            "price_ramp_5m": ramp5,
            "price_ramp_15m": (p - F.lag("price", 3).over(w)) / 15,
            "cross_spread": p - F.col("other"),
        }
    )
    return out.withColumns(
        {
            "price_accel": F.col("price_ramp_5m") - F.lag("price_ramp_5m").over(w),
            "cross_spread_ramp": F.col("cross_spread") - F.lag("cross_spread").over(w),
        }
    )


def supply_demand(df: DataFrame, keys: list[str], wind_rows: int = 8640, gas_rows: int = 2016) -> DataFrame:
    """Stress features from load, wind, solar, gas, coal, esr (5-minute rows), in blocks of the series with the rows that its frames reach."""
    base = sliding(df, keys, "t", {"_gas": quantile("gas", gas_rows, 0.95)}).withColumn("net_load", F.col("load") - F.col("wind") - F.col("solar"))

    def build(rows: DataFrame, w) -> DataFrame:
        diff = lambda c, n=1: F.col(c) - F.lag(c, n).over(w)
        out = rows.withColumns(
            {
                "net_load_ramp_5m": diff("net_load"),
                "net_load_ramp_15m": diff("net_load", 3),
                "wind_anomaly": (F.col("wind") - long_mean("wind", w, wind_rows, 1)) / (long_std("wind", w, wind_rows, 1) + 1e-6),
                "wind_ramp": diff("wind"),
                "wind_ramp_15m": diff("wind", 3),
                "coal_ramp": diff("coal"),
                "esr_is_charging": (F.col("esr") < 0).cast("int"),
                "esr_is_discharging": (F.col("esr") > 0).cast("int"),
                "solar_ramp": diff("solar"),
                "solar_ramp_15m": diff("solar", 3),
            }
        )
        return out.withColumn("net_load_accel", diff("net_load_ramp_5m"))

    night = F.hour("t") < 6
    return in_blocks(base, keys, "t", build, wind_rows).withColumns(
        {
            "gas_saturation": F.col("gas") / (F.col("_gas") + 1e-6),
            "coal_stress": F.coalesce((F.col("coal_ramp") > 0) & night, F.lit(False)).cast("int"),
        }
    ).drop("_gas")


def zone_weather(df: DataFrame, key: str = "station") -> DataFrame:
    """Hourly weather features on a gap-free grid, all one hour late."""
    g = fill.on_grid(df, [key], "t", 60).withColumn("_h", F.hour("t"))
    w, wh = series(key), W.partitionBy(key, "_h").orderBy("t")
    t, v, wd = F.col("temp"), F.col("wind"), F.col("wdir")
    north = F.coalesce((wd >= 315) | (wd <= 45), F.lit(False))
    d3 = t - F.lag("temp", 3).over(w)
    g = g.withColumn("_mean", F.avg("temp").over(wh.rowsBetween(-29, 0)))
    raw = {
        "t_anom": F.when(t.isNotNull(), t - F.col("_mean")),
        "delta_t_1h": t - F.lag("temp", 1).over(w),
        "delta_t_3h": d3,
        "wind_chill": rules.wind_chill_imperial_in_celsius(t, v),
        "cold_front": (F.coalesce(d3 < -5.0, F.lit(False)) & north).cast("int"),
    }
    g = g.withColumns(raw)
    return g.withColumns({c: F.lag(c).over(w) for c in raw}).drop("_h", "_mean")
