"""Joins that align series: as-of, pre-aggregated lookups, priority merges, slot pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import floor_time, plus_hours
from .dedup import first_source_wins, keep_last
from .ranked import prefix_scan


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], t: str, cols: list[str], shift_hours: int = 0, chunk_minutes: int = 60
) -> DataFrame:
    """For every left row the newest right row at or before its time, per key (right rows unique in key and time).

    One union and a chunked carry-forward: no range join, no pair expansion,
    and a key that owns much of the data is spread over its time chunks.
    """
    rt = plus_hours(F.col(t), shift_hours) if shift_hours else F.col(t)
    r = right.select(*keys, rt.alias(t), F.struct(*cols).alias("_right"), F.lit(0).alias("_side"))
    rest = [c for c in left.columns if c not in {*keys, t}]
    lft = left.select(*keys, t, F.struct(F.lit(1).alias("_x"), *rest).alias("_left"), F.lit(1).alias("_side"))
    both = r.unionByName(lft, allowMissingColumns=True)
    filled = prefix_scan(
        both, keys, floor_time(F.col(t), chunk_minutes), [F.col(t), F.col("_side")], lasts={"_match": F.col("_right")}
    ).filter(F.col("_side") == 1)
    return filled.select(
        *keys, t, *[F.col(f"_left.{c}").alias(c) for c in rest], *[F.col(f"_match.{c}").alias(c) for c in cols]
    )


def asof_grid(left: DataFrame, sources: list[tuple[DataFrame, list[str]]], keys: list[str], t: str) -> DataFrame:
    """As-of columns of several gridded sources at once: one union, one window, one exchange.

    For series with at most one row per key and slot, where a window partition
    is bounded by the time span; raw feeds take ``asof_backward``. Without keys
    there is one series: it is carried on day by day and then over the days.
    """
    rest = [c for c in left.columns if c not in {*keys, t}]
    both = left.select(*keys, t, F.struct(F.lit(1).alias("_x"), *rest).alias("_left"), F.lit(1).alias("_side"))
    for i, (right, cols) in enumerate(sources):
        r = right.select(*keys, t, F.struct(*cols).alias(f"_r{i}"), F.lit(0).alias("_side"))
        both = both.unionByName(r, allowMissingColumns=True)
    if keys:
        w = W.partitionBy(*keys).orderBy(t, "_side").rowsBetween(W.unboundedPreceding, 0)
        filled = both.select(*keys, t, "_left", *[F.last(f"_r{i}", ignorenulls=True).over(w).alias(f"_m{i}") for i in range(len(sources))])
    else:
        filled = prefix_scan(both, [], F.to_date(t), [F.col(t), F.col("_side")], lasts={f"_m{i}": F.col(f"_r{i}") for i in range(len(sources))})
    filled = filled.filter(F.col("_left").isNotNull())
    found = [F.col(f"_m{i}.{c}").alias(c) for i, (_, cols) in enumerate(sources) for c in cols]
    return filled.select(*keys, t, *[F.col(f"_left.{c}").alias(c) for c in rest], *found)


def unique_by(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The frame reduced to one row per key; the job fails on a duplicate key."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"duplicate keys in {what}")).cast("boolean"))
    return one.filter(checked).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return unique_by(left, keys, "left side").join(unique_by(right, keys, "right side"), keys)


def join_left_mean(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Left join on the per-key mean, so duplicate right rows cannot multiply left rows."""
    means = right.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    return left.join(means, keys, "left")


def join_left_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return left.join(keep_last(right, keys, order), keys, "left")


def time_shift_join(df: DataFrame, keys: list[str], t: str, col: str, hours: list[int]) -> DataFrame:
    """Values at exactly t - h; a gap gives NULL. All lags in one exchange on (key, t)."""
    out = df
    for h in hours:
        past = df.select(*keys, plus_hours(F.col(t), h).alias(t), F.col(col).alias(f"{col}_t{h}"))
        out = out.join(past, [*keys, t], "left")
    return out


def score_pairs(predictions: DataFrame, actuals: DataFrame, scored: DataFrame) -> DataFrame:
    """Match forecasts and actuals (NULL point equals NULL point), leave out pairs already scored."""
    p, a = predictions.alias("p"), actuals.alias("a")
    on = (
        (F.col("p.model") == F.col("a.market"))
        & F.col("p.settlement_point").eqNullSafe(F.col("a.settlement_point"))
        & (F.col("p.target_time") == F.col("a.target_time"))
    )
    return _scored(p.join(a, on), scored)


def score_pairs_contains(predictions: DataFrame, actuals: DataFrame, scored: DataFrame) -> DataFrame:
    """As ``score_pairs`` but the model name only has to contain the market; equi keys carry the join."""
    p, a = predictions.alias("p"), actuals.alias("a")
    on = (
        (F.col("p.settlement_point") == F.col("a.settlement_point"))
        & (F.col("p.target_time") == F.col("a.target_time"))
        & F.col("p.model").contains(F.col("a.market"))
    )
    return _scored(p.join(a, on), scored)


def _scored(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    error = F.col("predicted_value") - F.col("actual_value")
    out = pairs.select(
        F.col("p.id").alias("prediction_id"), F.col("a.id").alias("actual_id"),
        F.col("p.model").alias("model"), F.col("a.market").alias("market"),
        F.col("p.settlement_point").alias("settlement_point"), F.col("p.target_time").alias("target_time"),
        "predicted_value", "actual_value", error.alias("error"), F.abs(error).alias("abs_error"),
        (F.try_divide(error, F.col("actual_value")) * 100).alias("pct_error"),
    )
    return out.join(scored, ["prediction_id", "actual_id"], "left_anti")


def only_new(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not stored yet."""
    return candidates.join(existing.select(*keys), keys, "left_anti")


def fallback_sources(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Per key the value of the first source that has one, with the source's name."""
    tagged = [df.filter(F.col("price").isNotNull()).withColumn("source", F.lit(name)) for name, df in sources.items()]
    return first_source_wins(tagged, keys)


def fill_missing_only(base: DataFrame, other: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Existing non-empty values stay, blanks come from ``other``, new keys are added."""
    o = other.select(*keys, F.col(col).alias("_other"))
    kept = F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.col("_other"))
    return base.join(o, keys, "full").select(*keys, kept.alias(col))


def arbitrage_pairs(df: DataFrame, keys: list[str], slot: str, price: str, min_spread: float) -> DataFrame:
    """Buy/sell slot pairs of one day whose gain reaches ``min_spread``.

    A day is one array of at most 24 (or 96) slots, so the work per group is
    fixed; pairs under the limit are dropped inside the expression.
    """
    day = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(slot).alias("s"), F.col(price).alias("p")))).alias("_day"))

    def sells(buy: Column) -> Column:
        good = F.filter("_day", lambda x: (x["s"] > buy["s"]) & (x["p"] - buy["p"] >= min_spread))
        return F.transform(
            good, lambda x: F.struct(buy["s"].alias("buy"), x["s"].alias("sell"), (x["p"] - buy["p"]).alias("spread"))
        )

    pairs = day.select(*keys, F.explode(F.flatten(F.transform("_day", sells))).alias("x"))
    return pairs.select(*keys, "x.buy", "x.sell", "x.spread")


def slot_end(ts: Column, minutes: int = 5) -> Column:
    """Round a time up to the end of its slot; an exact boundary stays."""
    step = minutes * 60
    micros = F.unix_micros(ts)
    return F.timestamp_seconds(F.ceil(micros / (step * 1_000_000)).cast("long") * step)


def pivot_slots(df: DataFrame, slot: str, point: str, points: list[str], value: Column, order: Column) -> DataFrame:
    """Slot by point matrix; the first value per cell in ``order``. Fixed column list, so no extra pass."""
    return df.groupBy(slot).agg(*[F.min_by(value, F.when(F.col(point) == p, order)).alias(p) for p in points])


def two_decimals(c: Column) -> Column:
    """Half-even at two places on the decimal value."""
    return F.bround(c.cast("decimal(20,8)"), 2).cast("double")
