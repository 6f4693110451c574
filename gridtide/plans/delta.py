"""Day-ahead/real-time spread tables and day-before samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.frames import rolling, series
from ..operators.sliding import median, share_below_before, sliding


def spread_history(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread lags and trailing statistics (current row included), with spike flags and counts."""
    w = series(keys)
    cols: dict[str, Column] = {f"spread_lag_{n}h": F.lag("spread", n).over(w) for n in (24, 48, 72, 168)}
    for name, c in (("spread", "spread"), ("rtm", "rtm_mean"), ("dam", "dam_price")):
        for label, rows in (("24h", 24), ("7d", 168)):
            cols[f"{name}_mean_{label}"] = rolling(F.avg, c, w, rows)
        cols[f"{name}_std_24h"] = rolling(F.stddev_samp, c, w, 24)
    cols |= {
        "spread_std_7d": rolling(F.stddev_samp, "spread", w, 168),
        "spread_max_7d": rolling(F.max, "spread", w, 168),
        "spread_min_7d": rolling(F.min, "spread", w, 168),
        "spike_count_24h": rolling(F.sum, (F.abs("spread") > 20).cast("int"), w, 24),
        "rtm_spike_count_24h": rolling(F.sum, (F.col("rtm_mean") > 100).cast("int"), w, 24),
    }
    return df.withColumns(cols)


def samples(df: DataFrame, keys: list[str]) -> DataFrame:
    """One sample per target hour from what was known at the end of the last available day.

    df: keys, t, d, hour, spread, spread_last, rtm_mean, rtm_max, rtm_std, dam_price.
    Day-end states are window values of each day's last row; they are carried to
    the next available date with one join on (keys, date).
    """
    # ranks of a day's prices among the 168 rows before the day: one sort a day
    df = sliding(df, keys, "t", {"spread_median_7d": median("spread", 168), "dam_percentile_7d": share_below_before("dam_price", 168, "d", 25)})
    w = series(keys)
    last168, last24 = w.rowsBetween(-167, 0), w.rowsBetween(-23, 0)
    s = F.col("spread")
    state = {
        "spread_mean_7d": F.avg("spread").over(last168),
        "spread_std_7d": F.stddev_samp("spread").over(last168),
        "spread_max_7d": F.max("spread").over(last168),
        "spread_min_7d": F.min("spread").over(last168),
        "spread_median_7d": F.col("spread_median_7d"),
        "spread_mean_24h": F.avg("spread").over(last24),
        "spread_std_24h": F.stddev_samp("spread").over(last24),
        "rtm_mean_7d": F.avg("rtm_mean").over(last168),
        "rtm_std_7d": F.stddev_samp("rtm_mean").over(last168),
        "rtm_max_7d": F.max("rtm_max").over(last168),
        "rtm_mean_24h": F.avg("rtm_mean").over(last24),
        "rtm_volatility_24h": F.avg("rtm_std").over(last24),
        "dam_mean_7d": F.avg("dam_price").over(last168),
        "dam_std_7d": F.stddev_samp("dam_price").over(last168),
        "dam_mean_24h": F.avg("dam_price").over(last24),
        "spread_positive_ratio_7d": F.avg((s > 0).cast("double")).over(last168),
        "spread_positive_ratio_24h": F.avg((s > 0).cast("double")).over(last24),
        "spike_count_7d": F.sum((F.abs("spread") > 20).cast("int")).over(last168),
        "rtm_spike_count_7d": F.sum((F.col("rtm_mean") > 100).cast("int")).over(last168),
        "spread_trend_7d": F.avg("spread").over(last24) - F.avg("spread").over(w.rowsBetween(-167, -144)),
        "_rows": F.row_number().over(w),
    }
    ends = W.partitionBy(*keys).orderBy("t")
    tagged = df.select(*keys, "t", "d", *[c.alias(n) for n, c in state.items()], F.lead("d").over(ends).alias("_next"))
    snap = tagged.filter((F.col("_next") != F.col("d")) & (F.col("_rows") >= 168))
    snap = snap.drop("d", "t", "_rows")
    snap = snap.withColumnRenamed("_next", "d")

    by_hour = W.partitionBy(*keys, "hour").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    dow = df.withColumn("dow", F.weekday("d"))
    by_dow = W.partitionBy(*keys, "dow", "hour").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    target = dow.withColumns(
        {
            "spread_same_hour_hist": F.avg("spread").over(by_hour),
            "spread_same_hour_std": F.stddev_samp("spread").over(by_hour),
            "rtm_same_hour_hist": F.avg("rtm_mean").over(by_hour),
            "spread_same_dow_hour": F.avg("spread").over(by_dow),
            "spread_same_dow_hour_last": F.last("spread", ignorenulls=True).over(by_dow),
        }
    )
    j = target.drop("spread_median_7d").join(snap, [*keys, "d"])
    dam = F.col("dam_price")
    return j.withColumns(
        {
            "target_class": rules.spread_class(F.col("spread")),
            "target_is_peak": (F.col("hour").between(6, 10) | F.col("hour").between(17, 21)).cast("int"),
            "dam_vs_7d_mean": dam - F.col("dam_mean_7d"),
            "dam_vs_same_hour": dam - F.coalesce("rtm_same_hour_hist", "rtm_mean_7d"),
            "dam_price_level": rules.price_level_bin(dam),
        }
    )
