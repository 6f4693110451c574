"""Keyed aggregates of market, fuel, load and weather tables (all partially aggregated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import rules
from .align import two_decimals
from .fill import slot_grid, with_one_row
from .ranked import exact_quantiles


def hourly_average(df: DataFrame, keys: list[str], t: str, price: str) -> DataFrame:
    return df.groupBy(*keys, cal.floor_time(F.col(t), 60).alias("hour_start")).agg(F.avg(price).alias("lmp"))


def hourly_multi(df: DataFrame, keys: list[str], t: str, price: str, slots: int = 4) -> DataFrame:
    """Mean, max, min, last and sample deviation of hours that have all their slots."""
    hour = cal.floor_time(F.col(t), 60).alias("hour_start")
    return (
        df.groupBy(*keys, hour)
        .agg(
            F.avg(price).alias("rtm_mean"), F.max(price).alias("rtm_max"), F.min(price).alias("rtm_min"),
            F.max_by(price, t).alias("rtm_last"), F.stddev_samp(price).alias("rtm_std"), F.count("*").alias("n"),
        )
        .filter(F.col("n") == slots)
        .drop("n")
    )


def market_bucket_average(df: DataFrame, point: str, t: str, price: str) -> DataFrame:
    """UTC feed to 15-minute market buckets, two decimals."""
    parts = cal.utc_to_market_parts(df, t)
    keys = ["delivery_date", "delivery_hour", "delivery_interval", "repeated_hour", point]
    return parts.groupBy(*keys).agg(two_decimals(F.avg(price)).alias("lmp"))


def average_of_averages(df: DataFrame, keys: list[str], inner: Column, outer: Column, cols: list[str]) -> DataFrame:
    """Mean per inner bucket, then mean of those per outer bucket."""
    first = df.groupBy(*keys, inner.alias("_t"), outer.alias("hour_start")).agg(*[F.avg(c).alias(c) for c in cols])
    return first.groupBy(*keys, "hour_start").agg(*[F.avg(c).alias(c) for c in cols])


def _hour_ending(interval: str) -> Column:
    return (F.floor((F.col(interval) - 1) / 4) + 1).cast("int")


def fuel_pct_hourly(fuel: DataFrame) -> DataFrame:
    """Share of each coarse fuel group in the mapped total per (date, hour)."""
    f = fuel.withColumn("g", rules.mapped(F.col("fuel"), rules.FUEL_GROUPS)).filter(F.col("g").isNotNull())
    sums = f.groupBy("delivery_date", _hour_ending("interval_15min").alias("hour_ending")).agg(
        *[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("mw"))), F.lit(0.0)).alias(f"{g}_pct") for g in rules.COARSE_GROUPS],
        F.sum("mw").alias("_total"),
    )
    return sums.withColumns(
        {f"{g}_pct": F.try_divide(F.col(f"{g}_pct"), F.col("_total")) * 100 for g in rules.COARSE_GROUPS}
    ).drop("_total")


def fuel_mw_hourly(fuel: DataFrame) -> DataFrame:
    """Generation of each expanded group and their total per (date, hour); "other" is left out."""
    f = fuel.withColumn("g", rules.mapped(F.col("fuel"), rules.FUEL_GROUPS_EXPANDED)).filter(F.col("g").isNotNull())
    sums = f.groupBy("delivery_date", _hour_ending("interval_15min").alias("hour_ending")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("g") == g, F.col("mw"))), F.lit(0.0)).alias(f"{g}_gen_mw")
            for g in rules.EXPANDED_GROUPS
        ]
    )
    total = sum((F.col(f"{g}_gen_mw") for g in rules.EXPANDED_GROUPS), F.lit(0.0))
    return sums.withColumn("total_gen_mw", total)


def slot_sum_hour_mean(fuel: DataFrame, fuels: list[str] | None = None) -> DataFrame:
    """Sum over fuels per 15-minute slot, mean of the slots per hour."""
    f = fuel.filter(F.col("fuel").isin(fuels)) if fuels else fuel
    slots = f.groupBy("delivery_date", "interval_15min").agg(F.sum("mw").alias("mw"))
    return slots.groupBy("delivery_date", _hour_ending("interval_15min").alias("hour_ending")).agg(F.avg("mw").alias("mw"))


def resample_hourly(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """mean / first / last / max / min per hour; hours without rows stay as NULL rows."""
    hour = cal.floor_time(F.col(t), 60).alias("hour_start")
    agg = df.groupBy(*keys, hour).agg(
        F.avg(value).alias("mean"), F.min_by(value, t).alias("first"), F.max_by(value, t).alias("last"),
        F.max(value).alias("max"), F.min(value).alias("min"),
    )
    return slot_grid(agg, keys, "hour_start", 60).join(agg, [*keys, "hour_start"], "left")


def pivot_first(df: DataFrame, rows: list[str], col: str, values: list[str], value: str, order: Column) -> DataFrame:
    """Long to wide with a fixed column list; the first value per cell in ``order``."""
    return df.groupBy(*rows).agg(*[F.min_by(value, F.when(F.col(col) == v, order)).alias(v) for v in values])


def unpivot_regions(df: DataFrame, keys: list[str], regions: list[str], measures: list[str]) -> DataFrame:
    """Columns ``<measure>_<region>`` to one row per region."""
    per = F.array(*[F.struct(F.lit(r).alias("region"), *[F.col(f"{m}_{r}").alias(m) for m in measures]) for r in regions])
    return df.select(*keys, F.inline(per))


def price_statistics(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Exact statistics per key; quantiles come from a chunked scan over distinct values."""
    s = df.groupBy(*keys).agg(
        F.avg(price).alias("mean"), F.stddev_pop(price).alias("std"), F.min(price).alias("min"), F.max(price).alias("max")
    )
    q = exact_quantiles(df, keys, price, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return s.join(q, keys).withColumn("range", F.col("max") - F.col("min"))


def threshold_stats(df: DataFrame, keys: list[str], price: str, limit: float = 60.0, per_hour: int = 12) -> DataFrame:
    p = F.col(price)
    over = F.count_if(p > limit)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), over.alias("n_over"), (over / F.count("*")).alias("share_over"),
        F.avg(F.when(p <= limit, p)).alias("mean_under"), F.avg(p).alias("mean_all"), (over / per_hour).alias("hours_over"),
    )


def zone_weights(df: DataFrame, zone: str, load: str) -> DataFrame:
    per = df.groupBy(zone).agg(F.sum(load).alias("_l"))
    total = per.agg(F.sum("_l").alias("_t"))
    return with_one_row(per, total).select(zone, (F.col("_l") / F.col("_t")).alias("weight")).orderBy(F.desc("weight"))


def weighted_mean(df: DataFrame, weights: DataFrame, zone: str, keys: list[str], cols: list[str]) -> DataFrame:
    """Weighted mean over zones per key; a zone without a value does not count in the weight."""
    w = F.col("weight")
    joined = df.join(weights, zone)
    return joined.groupBy(*keys).agg(
        *[F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in cols]
    )


def regional_stats(df: DataFrame, keys: list[str], spread: list[str], mean_only: list[str]) -> DataFrame:
    aggs = []
    for c in spread:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in mean_only]
    return df.groupBy(*keys).agg(*aggs)


def latest_complete_day(df: DataFrame, day: str, hour: str, need: int = 24) -> DataFrame:
    """Rows of the newest date that has all its hours."""
    full = df.groupBy(day).agg(F.count_distinct(hour).alias("_h")).filter(F.col("_h") >= need)
    newest = full.agg(F.max(day).alias(day))
    return df.join(F.broadcast(newest), day, "left_semi")


def split_by_date(day: Column, train_end: str = "2024-01-01", val_end: str = "2025-01-01") -> Column:
    return F.when(day < F.lit(train_end).cast("date"), "train").when(day < F.lit(val_end).cast("date"), "val").otherwise("test")
