"""Per-day dispatch rules. A day is at most 24 hourly (or 288 five-minute) slots per point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def curtailment_schedule(
    df: DataFrame, keys: list[str], breakeven: float = 55.0, switching_cost: float = 40.0, min_hours: int = 2, spike_threshold: float = 0.7
) -> DataFrame:
    """ON/OFF per hour from hour, price, spike_prob, is_spike, bess_action.

    Forced hours split the day into runs of consecutive free hours.  Losses are
    never negative, so the best block that starts at a run's first losing hour
    ends at its last losing hour (or at the minimum length, whichever is later);
    it is taken when the run is long enough and the loss exceeds the switching
    cost.  That makes the greedy scan a plain aggregate per run.
    """
    loss = F.greatest(F.lit(0.0), F.col("price") - breakeven)
    spike = F.coalesce((F.col("spike_prob") >= spike_threshold) | F.col("is_spike"), F.lit(False))
    bess = F.coalesce((F.col("bess_action") == "discharge") & (loss > 0), F.lit(False))
    base = df.withColumns({"loss": loss, "_spike": spike, "_forced": spike | bess})
    free_no = F.row_number().over(W.partitionBy(*keys, "_forced").orderBy("hour"))
    base = base.withColumn("_run", F.col("hour") - free_no)
    run = W.partitionBy(*keys, "_forced", "_run")
    losing = F.when(F.col("loss") > 0, F.col("hour"))
    base = base.withColumns(
        {
            "_first": F.min(losing).over(run),
            "_last": F.max(losing).over(run),
            "_end": F.max("hour").over(run),
            "_total": F.sum("loss").over(run),
        }
    )
    block_end = F.greatest(F.col("_last"), F.col("_first") + (min_hours - 1))
    taken = ~F.col("_forced") & (F.col("_total") > switching_cost) & (block_end <= F.col("_end"))
    in_block = F.coalesce(taken & F.col("hour").between(F.col("_first"), block_end), F.lit(False))
    reason = (
        F.when(F.col("_spike"), "spike_alert")
        .when(F.col("_forced"), "bess_discharge_coordination")
        .when(in_block, "price_above_breakeven")
        .otherwise("price_below_breakeven")
    )
    action = F.when(F.col("_forced") | in_block, "OFF").otherwise("ON")
    return base.withColumns({"action": action, "reason": reason}).drop("_spike", "_forced", "_run", "_first", "_last", "_end", "_total")


def dispatch_savings(schedule: DataFrame, keys: list[str], load_mw: float = 10.0, switching_cost: float = 40.0) -> DataFrame:
    """Always-on against dispatched cost, switching included (each on/off pair counts once)."""
    w = W.partitionBy(*keys).orderBy("hour")
    prev = F.lag("action", 1, "ON").over(w)
    s = schedule.withColumn("_switch", (F.col("action") != prev).cast("int"))
    on = F.when(F.col("action") == "ON", F.col("price"))
    m = s.groupBy(*keys).agg(
        (F.sum("price") * load_mw).alias("always_on_cost"), F.coalesce(F.sum(on) * load_mw, F.lit(0.0)).alias("_run_cost"),
        F.sum("_switch").alias("transitions"), F.count(on).alias("hours_on"), F.coalesce(F.avg(on), F.lit(0.0)).alias("avg_on_price"),
        F.max("price").alias("peak_price"),
    )
    cost = F.col("_run_cost") + F.col("transitions") / 2 * switching_cost
    m = m.withColumn("dispatch_cost", cost).withColumn("savings", F.col("always_on_cost") - F.col("dispatch_cost"))
    pct = F.coalesce(F.try_divide(F.col("savings"), F.col("always_on_cost")) * 100, F.lit(0.0))
    return m.withColumn("savings_pct", pct).drop("_run_cost")


def battery_rule_schedule(
    df: DataFrame, keys: list[str], slot: str, price: str, e_max: float = 10.0, p_max: float = 2.5, eta: float = 0.95,
    soc_min: float = 0.1, soc_max: float = 0.9, soc_0: float = 0.5, c_deg: float = 2.0, ramp_cost: float = 0.1,
) -> DataFrame:
    """Charge at or below the day's 30 % price, discharge at or above the 70 % price, within the state of charge.

    The fold over one day's sorted array runs inside the JVM; quantiles are
    exact aggregates.  Output: one row per slot with charge, discharge, soc and
    the day's revenue.
    """
    q = F.percentile(price, F.array(F.lit(0.3), F.lit(0.7)))
    day = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(slot).alias("s"), F.col(price).alias("p")))).alias("_d"), q.alias("_q")
    )
    zero = F.struct(
        F.lit(float(soc_0)).alias("soc"),
        F.array().cast("array<struct<_s:bigint,_p:double,ch:double,dis:double,soc:double>>").alias("out"),
    )

    def step(acc, x):
        soc, p = acc["soc"], x["p"]
        room_in = F.greatest(F.lit(0.0), (F.lit(soc_max) - soc) * e_max)
        room_out = F.greatest(F.lit(0.0), (soc - F.lit(soc_min)) * e_max)
        charging = (p <= F.col("_q")[0]) & (room_in > 0)
        discharging = ~charging & (p >= F.col("_q")[1]) & (room_out > 0)
        ch = F.when(charging, F.least(F.lit(p_max), room_in / eta)).otherwise(0.0)
        dis = F.when(discharging, F.least(F.lit(p_max), room_out * eta)).otherwise(0.0)
        nxt = F.least(F.greatest(soc + ch * eta / e_max - dis / (eta * e_max), F.lit(soc_min)), F.lit(soc_max))
        row = F.struct(
            x["s"].cast("bigint").alias("_s"), p.alias("_p"), ch.alias("ch"), dis.alias("dis"), nxt.alias("soc")
        )
        return F.struct(nxt.alias("soc"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = day.select(*keys, F.inline(F.aggregate("_d", zero, step)["out"]))
    rows = rows.select(*keys, F.col("_s").alias(slot), F.col("_p").alias(price), "ch", "dis", "soc")
    net = F.col("dis") - F.col("ch")
    w = W.partitionBy(*keys).orderBy(slot)
    rows = rows.withColumns({"power_mw": net, "_step": F.coalesce(F.abs(net - F.lag(net).over(w)), F.lit(0.0))})
    value = F.col(price) * net - c_deg * F.col("dis") - ramp_cost * F.col("_step")
    action = F.when(F.abs(net) < 0.001, "idle").when(net > 0, "discharge").otherwise("charge")
    all_day = W.partitionBy(*keys)
    return rows.withColumns({"day_revenue": F.sum(value).over(all_day), "action": action}).drop("_step")


def battery_signals(
    df: DataFrame, keys: list[str], hold: float = 0.6, premium: float = 0.15, degradation: float = 2.0
) -> DataFrame:
    """Hourly signals from hour, action, power_mw, price, spike_prob, volatility, mining_action."""
    later = W.partitionBy(*keys).orderBy("hour").rowsBetween(1, W.unboundedFollowing)
    held = F.coalesce(
        (F.col("spike_prob") >= hold) & (F.col("action") == "discharge") & (F.max("spike_prob").over(later) >= hold), F.lit(False)
    )
    s = df.withColumn("_held", held).withColumns(
        {"action": F.when(F.col("_held"), "idle").otherwise(F.col("action")), "power_mw": F.when(F.col("_held"), 0.0).otherwise(F.abs("power_mw"))}
    )
    flag = F.when(F.col("_held"), "spike_hold").when(F.col("volatility") > F.col("price") * premium, "high_volatility").otherwise("normal")
    revenue = (
        F.when(F.col("action") == "discharge", F.col("price") * F.col("power_mw") - degradation * F.col("power_mw"))
        .when(F.col("action") == "charge", -F.col("price") * F.col("power_mw"))
        .otherwise(0.0)
    )
    return s.withColumns({"risk_flag": flag, "revenue": revenue, "mining_curtail": F.col("mining_action") == "OFF"}).drop("_held")


def signal_summary(signals: DataFrame, keys: list[str], premium: float = 0.15) -> DataFrame:
    m = signals.groupBy(*keys).agg(
        F.sum("revenue").alias("total_revenue"), F.count_if(F.col("action") == "charge").alias("charge_hours"),
        F.count_if(F.col("action") == "discharge").alias("discharge_hours"), F.count_if(F.col("action") == "idle").alias("idle_hours"),
        F.coalesce(F.max(F.when(F.col("action") == "discharge", F.col("price"))), F.lit(0.0)).alias("peak_discharge_price"),
        F.coalesce(F.avg(F.when(F.col("action") == "charge", F.col("price"))), F.lit(0.0)).alias("avg_charge_price"),
        F.max("volatility").alias("_v"),
    )
    adj = F.col("total_revenue") * (1 - premium * F.least(F.coalesce("_v", F.lit(0.0)) / 50, F.lit(1.0)))
    return m.withColumn("risk_adjusted_revenue", adj).drop("_v")


def interpolate_to_5min(df: DataFrame, keys: list[str], hour: str, price: str) -> DataFrame:
    """24 hourly values to 288 slots by straight lines; the last value is held."""
    w = W.partitionBy(*keys).orderBy(hour)
    nxt = F.coalesce(F.lead(price).over(w), F.col(price))
    slots = df.withColumn("_n", nxt).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    value = F.col(price) + (F.col("_n") - F.col(price)) * F.col("_k") / 12
    return slots.select(*keys, (F.col(hour) * 12 + F.col("_k")).alias("slot"), value.alias(price))
