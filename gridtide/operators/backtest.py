"""Strategy backtests, drawdown and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def apply_strategies(df: DataFrame, signals: dict[str, Column], spread: str) -> DataFrame:
    """One row per (trade candidate, strategy) with its signal and profit."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), s.cast("int").alias("signal")) for n, s in signals.items()]))
    out = df.withColumn("_s", each).withColumns({"strategy": F.col("_s.strategy"), "signal": F.col("_s.signal")}).drop("_s")
    return out.withColumn("pnl", F.col("signal") * F.col(spread))


def running_drawdown(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: str) -> DataFrame:
    """Cumulative sum, its running maximum and the difference (no task per key).

    Each chunk reports its sum and its highest inner total; both carry forward
    over the small chunk table, so the rows are read for one join only.
    """
    src = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    src = src.withColumn("_in", F.sum(value).over(inside))
    chunks = src.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"), F.max("_in").alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    chunks = chunks.withColumn("_peak", F.max(F.col("_off") + F.col("_top")).over(earlier)).drop("_sum", "_top")
    out = src.withColumn("_inmax", F.max("_in").over(inside)).join(chunks, [*keys, "_chunk"])
    out = out.withColumns(
        {
            "cumulative": F.col("_in") + F.col("_off"),
            "running_max": F.greatest(F.col("_peak"), F.col("_inmax") + F.col("_off")),
        }
    )
    return out.withColumn("drawdown", F.col("cumulative") - F.col("running_max")).drop("_chunk", "_in", "_inmax", "_off", "_peak")


def backtest_metrics(trades: DataFrame, key: str, day: str, chunk: Column, order: list[Column]) -> DataFrame:
    """Trades, totals, win rates, profit factor, daily Sharpe and worst drawdown per strategy."""
    pnl, signal = F.col("pnl"), F.col("signal")
    made = signal != 0
    long, short = signal == 1, signal == -1
    base = trades.groupBy(key).agg(
        F.count_if(made).alias("total_trades"), F.count_if(long).alias("long_trades"), F.count_if(short).alias("short_trades"),
        F.coalesce(F.sum(F.when(made, pnl)), F.lit(0.0)).alias("total_pnl"), F.coalesce(F.avg(F.when(made, pnl)), F.lit(0.0)).alias("avg_pnl"),
        F.coalesce(F.avg(F.when(made, (pnl > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(long, (pnl > 0).cast("double"))), F.lit(0.0)).alias("long_win_rate"),
        F.coalesce(F.avg(F.when(short, (pnl > 0).cast("double"))), F.lit(0.0)).alias("short_win_rate"),
        F.sum(F.when(made & (pnl > 0), pnl)).alias("_gain"), F.sum(F.when(made & (pnl < 0), -pnl)).alias("_loss"),
    )
    factor = F.when(F.col("total_trades") == 0, 0.0).when(
        F.coalesce("_loss", F.lit(0.0)) > 0, F.try_divide(F.coalesce("_gain", F.lit(0.0)), F.col("_loss"))
    ).otherwise(F.lit(float("inf")))
    daily = trades.groupBy(key, day).agg(F.sum("pnl").alias("_d"))
    sharpe = daily.groupBy(key).agg(F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"))
    sharpe = sharpe.select(key, F.when(F.col("_s") > 0, F.lit(252.0) ** 0.5 * F.try_divide(F.col("_m"), F.col("_s"))).otherwise(0.0).alias("sharpe"))
    dd = running_drawdown(trades.filter(made), [key], chunk, order, "pnl").groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))
    out = base.withColumn("profit_factor", factor).drop("_gain", "_loss").join(sharpe, key).join(dd, key, "left")
    return out.na.fill(0.0, subset=["max_drawdown"])


def trade_log_metrics(trades: DataFrame, key: str, t: str, chunk: Column, order: list[Column], cost: float = 0.5, hours: float = 8760.0) -> DataFrame:
    """Net metrics per strategy; the yearly trade count comes from the elapsed time."""
    net = trades.filter("signal <> 0").withColumn("net", F.col("pnl") - cost)
    m = net.groupBy(key).agg(
        F.count("*").alias("num_trades"), F.sum("net").alias("total_pnl"), F.avg("net").alias("avg_pnl"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.stddev_pop("net").alias("_s"),
        F.avg(F.abs("net")).alias("avg_trade_size"),
        ((F.unix_timestamp(F.max(t)) - F.unix_timestamp(F.min(t))) / 3600).alias("_h"),
    )
    per_year = F.when(F.col("_h") > 0, F.try_divide(F.col("num_trades") - 1, F.col("_h")) * hours).otherwise(0.0)
    std = F.when(F.col("num_trades") > 1, F.col("_s")).otherwise(1.0)
    sharpe = F.when(std > 0, F.try_divide(F.col("avg_pnl"), std) * F.sqrt(per_year)).otherwise(0.0)
    dd = running_drawdown(net, [key], chunk, order, "net").withColumn("_d", -F.col("drawdown"))
    # the peak is taken where the deepest drawdown is first reached
    worst = dd.groupBy(key).agg(F.max("_d").alias("max_drawdown"), F.max_by("running_max", F.struct("_d", -F.col("running_max"))).alias("_peak"))
    pct = F.when(F.col("_peak") > 0, F.try_divide(F.col("max_drawdown"), F.col("_peak")) * 100).otherwise(0.0)
    return m.withColumn("sharpe", sharpe).join(worst, key).withColumn("max_drawdown_pct", pct).drop("_s", "_h", "_peak")


def risk_metrics(daily: DataFrame, key: str, day: str, pnl: str) -> DataFrame:
    """Daily risk summary per key; a key has one row per day."""
    p = F.col(pnl)
    m = daily.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(p).alias("total_pnl"), F.avg(p).alias("avg_daily_pnl"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("volatility"), F.percentile(p, 0.05).alias("_v"),
        F.avg((p > 0).cast("double")).alias("win_rate"), F.max(p).alias("best_day"), F.min(p).alias("worst_day"),
    )
    dd = running_drawdown(daily, [key], F.trunc(day, "year"), [F.col(day)], pnl).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))
    sharpe = F.when(F.col("volatility") > 0, F.try_divide(F.col("avg_daily_pnl"), F.col("volatility")) * F.lit(365.0) ** 0.5).otherwise(0.0)
    var = F.when(F.col("n") >= 2, F.col("_v")).otherwise(0.0)
    return m.withColumns({"sharpe": sharpe, "var_95": var}).join(dd, key).drop("_v")


def revenue_impact(df: DataFrame, keys: list[str], y: str, yhat: str, price: str, power: float = 25.0, capacity: float = 100.0, hold: float = 5.0) -> DataFrame:
    """Value of spike alarms: captured and missed revenue, cost of false alarms."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    m = df.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(t & p, F.col(price))), F.lit(0.0)) * power).alias("tp_revenue"),
        (F.coalesce(F.sum(F.when(t & ~p, F.col(price))), F.lit(0.0)) * power).alias("missed_revenue"),
        (F.count_if(~t & p) * hold * capacity).alias("false_alarm_cost"),
    )
    total = F.col("tp_revenue") + F.col("missed_revenue")
    return m.withColumns(
        {
            "net_value": F.col("tp_revenue") - F.col("false_alarm_cost"),
            "capture_rate": F.when(total > 0, F.try_divide(F.col("tp_revenue"), total)).otherwise(0.0),
        }
    )


def daily_battery_pnl(signals: DataFrame, actual: DataFrame, keys: list[str], slot: str, e_max: float = 10.0,
                      efficiency: float = 0.9, degradation: float = 2.0) -> DataFrame:
    """Realised daily result of a schedule; actual prices where known, otherwise the scheduled price."""
    s = signals.join(actual, [*keys, slot], "left").withColumn("_p", F.coalesce("actual_price", "dam_price"))
    ch, dis = F.col("action") == "charge", F.col("action") == "discharge"
    power = F.abs("power_mw")
    m = s.groupBy(*keys).agg(
        F.sum(F.when(ch, F.col("_p") * power).otherwise(0.0)).alias("charge_cost"),
        F.sum(F.when(dis, F.col("_p") * power).otherwise(0.0)).alias("discharge_revenue"),
        F.sum(F.when(ch, power).otherwise(0.0)).alias("_c"), F.sum(F.when(dis, power).otherwise(0.0)).alias("_d"),
    )
    return m.withColumns(
        {
            "cycles": F.least("_c", "_d") / e_max,
            "degradation_cost": F.col("_d") * degradation,
            "actual_revenue": F.col("discharge_revenue") * efficiency - F.col("charge_cost"),
        }
    ).withColumn("net_pnl", F.col("actual_revenue")).drop("_c", "_d")


def rolling_pnl(daily: DataFrame, key: str, day: str, days: int, values: list[str]) -> DataFrame:
    """Totals of the newest ``days`` days per key (calendar cut-off from the key's newest day)."""
    newest = daily.groupBy(key).agg(F.max(day).alias("_last"))
    recent = daily.join(newest, key).filter(F.col(day) >= F.date_sub("_last", days))
    return recent.groupBy(key).agg(F.count("*").alias("days"), *[F.sum(v).alias(v) for v in values])


