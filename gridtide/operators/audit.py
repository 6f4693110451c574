"""Data quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fill import day_grid


def overview(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (df, t) in tables.items():
        one = df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n"),
            F.min(t).cast("timestamp").alias("first_time"), F.max(t).cast("timestamp").alias("last_time"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def missing_dates(df: DataFrame, key: str, day: str) -> DataFrame:
    """Dates of the global range that a key lacks."""
    present = df.select(key, day).distinct()
    return day_grid(present, [key], day).join(present, [key, day], "left_anti")


def interval_gaps(df: DataFrame, key: str, day: str, slot: str, expected: int) -> DataFrame:
    """(key, day) with fewer slots than expected, absent days included."""
    counts = df.groupBy(key, day).agg(F.count_distinct(slot).alias("n"))
    grid = day_grid(counts, [key], day).join(counts, [key, day], "left").na.fill(0, subset=["n"])
    return grid.filter(F.col("n") < expected).withColumn("missing", expected - F.col("n"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_null")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n_duplicate_groups"))


def anomalies(df: DataFrame, price: str, high: float = 5000.0, low: float = -500.0, keys: list[str] = ()) -> DataFrame:
    p = F.col(price)
    return df.groupBy(*keys).agg(
        F.count_if(p < 0).alias("n_negative"), F.count_if(p == 0).alias("n_zero"), F.count_if(p > high).alias("n_high"),
        F.count_if(p < low).alias("n_low"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("avg"),
    )


def coverage(df: DataFrame, key: str, t: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(t).alias("first_time"), F.max(t).alias("last_time"))


def boundary_gap(history: DataFrame, live: DataFrame, key: str, t: str) -> DataFrame:
    """Hours between the end of the history and the start of the live feed per key."""
    end = history.groupBy(key).agg(F.max(t).alias("history_end"))
    start = live.groupBy(key).agg(F.min(t).alias("live_start"))
    hours = (F.unix_timestamp("live_start") - F.unix_timestamp("history_end")) / 3600
    return end.join(start, key).withColumn("gap_hours", hours)
