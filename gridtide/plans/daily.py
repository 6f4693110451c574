"""Day-ahead features per (date, hour) from one 24-value array per available date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import calendar as cal

FEATURES = [
    "hour", "day_of_week", "day_of_month", "month", "quarter", "week_of_year", "is_weekend", "is_holiday", "is_peak_hour", "is_summer",
    "dam_lag_24h", "dam_lag_24h_prev", "dam_lag_24h_next", "dam_lag_48h", "dam_lag_168h", "dam_d1_mean", "dam_d1_max", "dam_d1_min",
    "dam_d1_std", "dam_7d_mean", "dam_7d_same_hour_mean", "dam_4w_same_dow_hour_mean", "dam_d1_hour_ratio", "dam_7d_hour_ratio",
    "dam_d1_vs_d2", "dam_d1_vs_d7", "dam_trend_3d", "dam_7d_cv", "dam_d1_range", "dam_7d_same_hour_std",
    "dam_d1_spike_count", "dam_7d_spike_count", "dam_d1_had_spike", "dam_lag_24h_is_spike", "dam_d1_max_hour",
]


def _present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _mean(a: Column) -> Column:
    p = _present(a)
    return F.try_divide(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), F.size(p))


def _std(a: Column) -> Column:
    """Population deviation around the mean."""
    p = _present(a)
    m = _mean(a)
    return F.sqrt(F.try_divide(F.aggregate(p, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(p)))


def day_arrays(df: DataFrame, keys: list[str], date: str, hour: str, price: str, order: str | None = None) -> DataFrame:
    """One row per (keys, date) with the 24 hourly prices; ``hour`` is 1-24.

    An hour that comes twice (autumn change) keeps its first price by ``order``; without that column, the smaller price.
    """
    at = lambda h, c: F.when((F.col(hour) == h) & F.col(price).isNotNull(), F.col(c))
    cells = [F.min_by(at(h, price), at(h, order)) if order else F.min(at(h, price)) for h in range(1, 25)]
    return df.groupBy(*keys, date).agg(F.array(*cells).alias("p"))


def daily_features(df: DataFrame, keys: list[str], date: str, hour: str, price: str, min_history: int = 28, spike: float = 100.0, order: str | None = None) -> DataFrame:
    """35 features. Offsets count available dates; day D-1 and D-7 must be complete."""
    days = day_arrays(df, keys, date, hour, price, order)
    w = W.partitionBy(*keys).orderBy(date)
    wanted = [*range(1, 8), 14, 21, 28]
    days = days.withColumns({f"d{k}": F.lag("p", k).over(w) for k in wanted} | {"_i": F.row_number().over(w)})
    full = lambda c: ~F.exists(c, lambda x: x.isNull())
    days = days.filter(F.col("_i") > min_history).filter(full("d1") & full("d7"))
    week = F.flatten(F.array(*[F.col(f"d{k}") for k in range(1, 8)]))
    days = days.withColumn("_week", _present(week)).withColumns(
        {
            "dam_d1_mean": _mean(F.col("d1")),
            "dam_d1_max": F.array_max("d1"),
            "dam_d1_min": F.array_min("d1"),
            "dam_d1_std": _std(F.col("d1")),
            "dam_7d_mean": _mean(F.col("_week")),
            "_week_std": _std(F.col("_week")),
            "_d2_mean": _mean(F.col("d2")),
            "_d3_mean": _mean(F.col("d3")),
            "_d7_mean": _mean(F.col("d7")),
            "dam_d1_spike_count": F.size(F.filter("d1", lambda x: x > spike)),
            "dam_7d_spike_count": F.size(F.filter("_week", lambda x: x > spike)),
            "dam_d1_max_hour": F.array_position("d1", F.array_max("d1")),
        }
    )
    rows = days.select("*", F.posexplode("p").alias("_h", "target")).filter(F.col("target").isNotNull())
    at = lambda k, off=0: F.try_element_at(F.col(f"d{k}"), F.least(F.greatest(F.col("_h") + 1 + off, F.lit(1)), F.lit(24)))
    rows = rows.withColumns({"_same7": F.array(*[at(k) for k in range(1, 8)]), "_same4": F.array(*[at(k) for k in (7, 14, 21, 28)])})
    day = F.col(date)
    rows = rows.withColumns(
        {
            "hour": F.col("_h") + 1,
            "day_of_week": F.weekday(day),
            "day_of_month": F.dayofmonth(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "week_of_year": F.weekofyear(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
            "is_holiday": cal.major_holiday(day),
            "is_peak_hour": (F.col("_h") + 1).isin(cal.PEAK_HOURS).cast("int"),
            "is_summer": F.month(day).isin(cal.SUMMER_MONTHS).cast("int"),
            "dam_lag_24h": at(1),
            "dam_lag_24h_prev": at(1, -1),
            "dam_lag_24h_next": at(1, 1),
            "dam_lag_48h": at(2),
            "dam_lag_168h": at(7),
        }
    )
    c = F.col
    rows = rows.withColumns(
        {
            "dam_7d_same_hour_mean": F.coalesce(_mean(c("_same7")), c("dam_lag_24h")),
            "dam_4w_same_dow_hour_mean": F.coalesce(_mean(c("_same4")), c("dam_lag_168h")),
            "dam_d1_vs_d2": c("dam_d1_mean") - c("_d2_mean"),
            "dam_d1_vs_d7": c("dam_d1_mean") - c("_d7_mean"),
            "dam_trend_3d": (c("dam_d1_mean") - c("_d3_mean")) / 3,
            "dam_7d_cv": c("_week_std") / (c("dam_7d_mean") + 1e-6),
            "dam_d1_range": c("dam_d1_max") - c("dam_d1_min"),
            "dam_7d_same_hour_std": F.when(F.size(_present(c("_same7"))) > 1, _std(c("_same7"))).otherwise(0.0),
            "dam_d1_had_spike": (c("dam_d1_spike_count") > 0).cast("int"),
            "dam_lag_24h_is_spike": (c("dam_lag_24h") > spike).cast("int"),
        }
    )
    rows = rows.withColumns(
        {
            "dam_d1_hour_ratio": c("dam_lag_24h") / (c("dam_d1_mean") + 1e-6),
            "dam_7d_hour_ratio": c("dam_7d_same_hour_mean") / (c("dam_7d_mean") + 1e-6),
        }
    )
    return rows.select(*keys, date, *FEATURES, "target")
