"""Wind and load series features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import rolling, series
from ..operators.ranked import exact_quantiles


def lag_roll(
    df: DataFrame, keys: list[str], c: str, prefix: str, lags: list[int], windows: list[int], changes: list[int], floor: float, w: WindowSpec | None = None
) -> DataFrame:
    """Lags, shifted rolling statistics, changes and rates with a floored base."""
    w = w if w is not None else series(keys)
    cols: dict[str, Column] = {f"{prefix}_lag_{n}h": F.lag(c, n).over(w) for n in lags}
    for n in windows:
        for s, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            cols[f"{prefix}_roll_{n}h_{s}"] = rolling(fn, c, w, n, 1, 1)
    for n in changes:
        change = F.lag(c, 1).over(w) - F.lag(c, 1 + n).over(w)
        cols[f"{prefix}_change_{n}h"] = change
        base = F.lag(c, 1 + n).over(w)
        cols[f"{prefix}_roc_{n}h"] = F.when(base.isNotNull(), change / F.greatest(base, F.lit(float(floor))))
    return df.withColumns(cols)


def ramp_flags(df: DataFrame, prefix: str, one: float = 1000.0, three: float = 2000.0) -> DataFrame:
    c1, c3 = F.col(f"{prefix}_change_1h"), F.col(f"{prefix}_change_3h")
    hit = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return df.withColumns({"ramp_down_1h": hit(c1 < -one), "ramp_down_3h": hit(c3 < -three), "ramp_up_1h": hit(c1 > one)})


def true_time_rolling(df: DataFrame, keys: list[str], c: str, hours: list[int]) -> DataFrame:
    """Mean of the values stamped in [t - w hours, t - 1 hour], by time and not by row count."""
    w = series(keys, "_s")
    out = df.withColumn("_s", F.unix_timestamp("t"))
    return out.withColumns({f"{c}_mean_{h}h": F.avg(c).over(w.rangeBetween(-h * 3600, -3600)) for h in hours}).drop("_s")


def gradient(c: str, w) -> Column:
    """Central difference; one-sided at both ends."""
    prev, nxt = F.lag(c).over(w), F.lead(c).over(w)
    return F.coalesce((nxt - prev) / 2, nxt - F.col(c), F.col(c) - prev)


def gradient_acceleration(df: DataFrame, keys: list[str], c: str, w: WindowSpec | None = None) -> DataFrame:
    w = w if w is not None else series(keys)
    out = df.withColumn("change_rate", gradient(c, w))
    return out.withColumn("acceleration", gradient("change_rate", w))


def forward_ramp(df: DataFrame, keys: list[str], c: str, horizons: list[int], w: WindowSpec | None = None) -> DataFrame:
    """Change to h rows ahead (0 at the tail) and its negative part."""
    w = w if w is not None else series(keys)
    cols: dict[str, Column] = {}
    for h in horizons:
        ramp = F.coalesce(F.lead(c, h).over(w) - F.col(c), F.lit(0.0))
        cols[f"ramp_{h}h"] = ramp
        cols[f"ramp_down_{h}h"] = F.least(ramp, F.lit(0.0))
    return df.withColumns(cols)


def conformal(df: DataFrame, keys: list[str], is_val: Column, actual: str, pred: str, p: float = 0.8) -> DataFrame:
    """Bias-corrected forecast with symmetric and asymmetric bands from the validation residuals."""
    r = F.col(actual) - F.col(pred)
    val = df.filter(is_val).select(*keys, r.alias("_r"), F.abs(r).alias("_a"))
    stats = val.groupBy(*keys).agg(F.avg("_r").alias("_bias")).join(exact_quantiles(val, keys, "_a", {"_half": p}), keys)
    stats = stats.join(exact_quantiles(val, keys, "_r", {"_q10": 0.1, "_q90": 0.9}), keys)
    j = df.filter(~is_val).join(stats, keys)
    out = j.withColumns(
        {
            "corrected": F.col(pred) + F.col("_bias"),
            "low": F.col(pred) - F.col("_half"),
            "high": F.col(pred) + F.col("_half"),
            "low_asym": F.col(pred) + F.col("_q10"),
            "high_asym": F.col(pred) + F.col("_q90"),
        }
    )
    a = F.col(actual)
    return out.withColumns(
        {
            "covered": ((a >= F.col("low")) & (a <= F.col("high"))).cast("int"),
            "covered_asym": ((a >= F.col("low_asym")) & (a <= F.col("high_asym"))).cast("int"),
        }
    ).drop("_bias", "_half", "_q10", "_q90")
