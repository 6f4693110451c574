"""Gap filling and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_nullable(df: DataFrame, keys: list[str], order: str, forward=(), zero=(), required=()) -> DataFrame:
    """Drop rows lacking a required value, carry ``forward`` columns on, then NULL to zero."""
    from .ranked import prefix_scan  # which uses this module

    out = df.na.drop(subset=list(required)) if required else df
    if forward:  # by day and then over the days, so a long series is many tasks
        out = prefix_scan(out, keys, F.to_date(order), [F.col(order)], lasts={c: F.col(c) for c in forward}).select(*out.columns)
    return out.na.fill(0, subset=list(zero)) if zero else out


def slot_grid(df: DataFrame, keys: list[str], t: str, minutes: int) -> DataFrame:
    """All slots between the first and last slot of every key."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(t))


def on_grid(df: DataFrame, keys: list[str], t: str, minutes: int) -> DataFrame:
    """Left join onto the full slot grid: gaps become rows with NULL measures."""
    return slot_grid(df, keys, t, minutes).join(df, [*keys, t], "left")


def day_grid(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Keys present in ``df`` by every date of the global range (bounded: keys x days)."""
    bounds = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    per_key = with_one_row(df.select(*keys).distinct(), bounds)
    return per_key.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))


def with_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a global aggregate (one row) to every row as a scalar subquery: no join at all."""
    one = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("_s")).scalar()
    return df.select("*", one.alias("_one")).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in stats.columns])
