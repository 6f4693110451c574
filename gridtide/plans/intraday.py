"""15-minute price features: lags, rolling statistics, momentum, spikes, volatility, day-ahead context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import calendar as cal
from ..functions.frames import long_mean, long_std, ratio, rolling, sample_skew, series
from ..operators.sliding import Stat, below, count, median, skew, sliding, up_to

EPS = 1e-6
HORIZON_WINDOWS = {"1h": 4, "3h": 12, "6h": 24, "24h": 96, "7d": 672, "14d": 1344}


def lags(df: DataFrame, keys: list[str], c: str = "price") -> DataFrame:
    w = series(keys)
    out = df.withColumns({f"price_lag_{n}": F.lag(c, n).over(w) for n in (1, 2, 3, 4, 96, 672)})
    return out.withColumns(
        {
            "price_lag_4_diff_lag_96": F.col("price_lag_4") - F.col("price_lag_96"),
            "price_lag_672_diff_lag_96": F.col("price_lag_672") - F.col("price_lag_96"),
        }
    )


def horizon_lags(df: DataFrame, keys: list[str], horizon: int, c: str = "price") -> DataFrame:
    """Short lags never shorter than the horizon, plus day, week and year lags."""
    w = series(keys)
    cols = {f"price_lag_{n}": F.lag(c, max(n, horizon)).over(w) for n in (1, 2, 3, 4)}
    cols |= {f"price_lag_{n}": F.lag(c, n).over(w) for n in (96, 192, 288, 672, 1344, 35040)}
    return df.withColumns(cols)


def rolling_stats(df: DataFrame, keys: list[str], c: str = "price") -> DataFrame:
    w = series(keys)
    spec = [
        ("1h", 4, 1, ("mean", "std", "max", "min")),
        ("3h", 12, 4, ("mean", "std")),
        ("24h", 96, 24, ("mean", "std", "max", "min")),
    ]
    first = F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({"_x0": first, "_x": F.col(c) - first})
    fns = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    cols = {f"price_{s}_{n}": rolling(fns[s], c, w, rows, 0, need) for n, rows, need, stats in spec for s in stats}
    frame = w.rowsBetween(-95, 0)
    cols["price_skew_24h"] = F.when(F.count(c).over(frame) >= 24, sample_skew(F.col(c), frame))
    cols["price_mean_7d"] = F.col("_x0") + long_mean("_x", w, 672, 168)
    cols["price_std_7d"] = long_std("_x", w, 672, 168)
    return df.withColumns(cols).drop("_x0", "_x")


def horizon_rolling(df: DataFrame, keys: list[str], horizon: int, names: list[str], c: str = "price") -> DataFrame:
    """Shifted windows with half-window minimum; median, skew and range for windows of 24 rows and more."""
    w = series(keys)
    cols: dict[str, Column] = {}
    ordered: dict[str, Stat] = {}
    for name in names:
        rows = HORIZON_WINDOWS[name]
        need = max(1, rows // 2)
        for s, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            cols[f"price_{s}_{name}"] = rolling(fn, c, w, rows, horizon, need)
        if rows >= 24:
            ordered |= {f"price_median_{name}": median(c, rows, horizon, need), f"price_skew_{name}": skew(c, rows, horizon, need)}
            cols[f"price_range_{name}"] = cols[f"price_max_{name}"] - cols[f"price_min_{name}"]
    out = df.withColumns(cols)
    return sliding(out, keys, "t", ordered) if ordered else out


def same_time_means(df: DataFrame, keys: list[str], c: str = "price") -> DataFrame:
    """Mean of the same slot over the last 7 days and the last 4 weeks, of the lags that exist."""
    w = series(keys)

    def mean_of(steps: list[int]) -> Column:
        values = [F.lag(c, n).over(w) for n in steps]
        total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
        return F.try_divide(total, sum((v.isNotNull().cast("int") for v in values), F.lit(0)))

    return df.withColumns(
        {"same_time_mean": mean_of([96 * i for i in range(1, 8)]), "same_time_dow_mean": mean_of([672 * i for i in range(1, 5)])}
    )


def same_slot_history(df: DataFrame, keys: list[str], horizon: int, c: str = "price") -> DataFrame:
    """Slot-keyed variant: rolling over earlier rows of the same time of day (and weekday)."""
    t = F.col("t")
    df = df.withColumns({"_s": F.hour(t) * 60 + F.minute(t), "_dow": F.weekday(t)})
    day = W.partitionBy(*keys, "_s").orderBy("t")
    dow = W.partitionBy(*keys, "_s", "_dow").orderBy("t")
    return df.withColumns(
        {
            "same_time_dow_mean_4w": rolling(F.avg, c, dow, 4, horizon, 1),
            "same_time_dow_std_4w": rolling(F.stddev_samp, c, dow, 4, horizon, 1),
            "same_time_mean_7d": rolling(F.avg, c, day, 7, horizon, 1),
        }
    ).drop("_s", "_dow")


def momentum(df: DataFrame, keys: list[str], c: str = "price") -> DataFrame:
    w, p = series(keys), F.col(c)
    mean1, std1 = rolling(F.avg, c, w, 4, 0, 1), rolling(F.stddev_samp, c, w, 4, 0, 1)
    mean24, std24 = rolling(F.avg, c, w, 96, 0, 24), rolling(F.stddev_samp, c, w, 96, 0, 24)
    lag = lambda n: F.lag(c, n).over(w)
    return df.withColumns(
        {
            "price_diff_1": p - lag(1),
            "price_diff_4": p - lag(4),
            "price_diff_96": p - lag(96),
            "price_pct_1": ratio(p - lag(1), lag(1)),
            "price_momentum_1h": (p - mean1) / (std1 + EPS),
            "price_momentum_24h": (p - mean24) / (std24 + EPS),
            "price_vs_mean_24h": ratio(p, mean24 + EPS),
            "price_acceleration": (p - lag(1)) - (lag(1) - lag(2)),
        }
    )


def spike_counts(df: DataFrame, keys: list[str], limits: list[int], c: str = "price") -> DataFrame:
    w, p = series(keys), F.col(c)
    cols: dict[str, Column] = {}
    for lim in limits:
        hit = (p > lim).cast("int")
        cols[f"is_spike_{lim}"] = hit
        cols[f"spike_count_24h_{lim}"] = F.sum(hit).over(w.rowsBetween(-95, 0))
        cols[f"spike_count_7d_{lim}"] = F.sum(hit).over(w.rowsBetween(-671, 0))
    top, low = rolling(F.max, c, w, 96, 0, 24), rolling(F.min, c, w, 96, 0, 24)
    cols |= {"price_vs_max_24h": ratio(p, top + EPS), "price_vs_min_24h": ratio(p, low + EPS), "price_range_24h": top - low}
    return df.withColumns(cols)


def intervals_since(df: DataFrame, keys: list[str], flag: Column, name: str = "intervals_since_spike") -> DataFrame:
    """Rows since the flag last held; NULL before the first time."""
    w = series(keys)
    numbered = df.withColumns({"_rn": F.row_number().over(w), "_f": flag})
    last = F.max(F.when(F.col("_f"), F.col("_rn"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn(name, F.col("_rn") - last).drop("_rn", "_f")


def percent_rank(df: DataFrame, keys: list[str], rows: int = 96, min_periods: int = 24, c: str = "price") -> DataFrame:
    """Share of the earlier window values below the current one, and the average-rank percentile."""
    ranked = sliding(df, keys, "t", {"_n": count(c, rows), "_less": below(c, rows), "_upto": up_to(c, rows)})
    n, less = F.col("_n"), F.coalesce("_less", F.lit(0))
    same = F.coalesce(F.col("_upto") - F.col("_less"), F.lit(0))
    return ranked.withColumns(
        {
            "share_below": F.when(n >= min_periods, F.coalesce(F.try_divide(less, n - 1), F.lit(0.5))),
            "rank_pct": F.when(n >= rows, (less + (same + 1) / 2) / n),
        }
    ).drop("_n", "_less", "_upto")


def volatility(df: DataFrame, keys: list[str], c: str = "price") -> DataFrame:
    w = series(keys)
    mean24, std24 = rolling(F.avg, c, w, 96, 0, 24), rolling(F.stddev_samp, c, w, 96, 0, 24)
    out = df.withColumns(
        {
            "_std1": rolling(F.stddev_samp, c, w, 4, 0, 1),
            "_std24": std24,
            "cv_24h": ratio(std24, mean24 + EPS),
            "amplitude_1h": rolling(F.max, c, w, 4, 0, 1) - rolling(F.min, c, w, 4, 0, 1),
        }
    )
    return out.withColumns(
        {
            "volatility_change": F.col("_std1") - F.lag("_std1", 4).over(w),
            "recent_volatility_ratio": F.col("_std1") / (F.col("_std24") + EPS),
        }
    ).drop("_std1", "_std24")


def horizon_flags(df: DataFrame, horizon: int) -> DataFrame:
    target = F.timestamp_seconds(F.unix_timestamp("t") + horizon * 900)
    return df.withColumns(
        {
            "target_hour": F.hour(target),
            "target_minute": F.minute(target),
            "target_is_peak": F.hour(target).isin(cal.PEAK_HOURS).cast("int"),
            "crosses_hour": (F.hour("t") != F.hour(target)).cast("int"),
            "horizon_minutes": F.lit(horizon * 15),
        }
    )


def dam_context(df: DataFrame, dam: DataFrame, keys: list[str], horizon: int, c: str = "price") -> DataFrame:
    """Day-ahead price now and at the target time (known in advance), spread statistics, z-score."""
    on = [k for k in keys if k in dam.columns]
    here = dam.select(*on, F.col("t").alias("_h"), F.col("dam").alias("dam_price_current"))
    there = dam.select(*on, F.col("t").alias("_g"), F.col("dam").alias("dam_price_target"))
    target = F.timestamp_seconds(F.unix_timestamp("t") + horizon * 900)
    j = df.withColumns({"_h": cal.floor_time(F.col("t"), 60), "_g": cal.floor_time(target, 60)})
    j = j.join(here, [*on, "_h"], "left").join(there, [*on, "_g"], "left").drop("_h", "_g")
    w = series(keys)
    now, then = F.col("dam_price_current"), F.col("dam_price_target")
    spread = F.col(c) - now
    return j.withColumns(
        {
            "rtm_dam_spread": spread,
            "spread_mean_1h": rolling(F.avg, spread, w, 4, 0, 1),
            "spread_mean_24h": rolling(F.avg, spread, w, 96, 0, 24),
            "spread_std_24h": rolling(F.stddev_samp, spread, w, 96, 0, 24),
            "rtm_dam_ratio": ratio(F.col(c), now + 1),
            "dam_change": then - now,
            "dam_change_pct": ratio(then - now, now + 1),
            "dam_target_zscore": (then - rolling(F.avg, now, w, 96, 0, 24)) / (rolling(F.stddev_samp, now, w, 96, 0, 24) + 1),
            "dam_target_above_100": F.coalesce(then > 100, F.lit(False)).cast("int"),
            "dam_target_above_200": F.coalesce(then > 200, F.lit(False)).cast("int"),
        }
    )


def targets(df: DataFrame, keys: list[str], horizon: int, c: str = "price") -> DataFrame:
    ahead = F.lead(c, horizon).over(series(keys))
    return df.withColumns({"actual_future_price": ahead, "target_delta": ahead - F.col(c)})


def multi_horizon(df: DataFrame, keys: list[str], steps: list[int], c: str = "price") -> DataFrame:
    w = series(keys)
    return df.withColumns({f"target_{n}": F.lead(c, n).over(w) for n in steps})


def rtm_derived(df: DataFrame, absolute_mean: bool = True) -> DataFrame:
    mean = F.col("rtm_roll_24h_mean")
    base = F.abs(mean) if absolute_mean else mean
    return df.withColumns(
        {
            "rtm_volatility": ratio(F.col("rtm_roll_24h_std"), base + 1),
            "rtm_momentum": F.col("rtm_lag_1h") - F.col("rtm_lag_4h"),
            "rtm_mean_reversion": F.col("rtm_lag_1h") - mean,
        }
    )


def baselines(df: DataFrame, keys: list[str], horizon: int, c: str = "price") -> DataFrame:
    """Naive forecasts: lag of the horizon, same hour yesterday, last value, mean of the same hour so far."""
    w = series(keys)
    df = df.withColumn("_h", F.hour("t"))
    past = W.partitionBy(*keys, "_h").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns(
        {
            "naive_lag": F.lag(c, horizon).over(w),
            "naive_yesterday": F.lag(c, 24).over(w),
            "naive_persistence": F.lag(c, 1).over(w),
            "naive_hour_mean": F.avg(c).over(past),
        }
    ).drop("_h")


def sliding_sequences(df: DataFrame, keys: list[str], features: list[str], target: str, length: int, horizon: int) -> DataFrame:
    """Full windows of ``length`` feature rows with the target ``horizon`` rows after the window's end."""
    w = series(keys)
    window = F.collect_list(F.struct(*features)).over(w.rowsBetween(-(length - 1), 0))
    out = df.withColumns({"window": window, "y": F.lead(target, horizon).over(w)})
    return out.filter((F.size("window") == length) & F.col("y").isNotNull())
