"""Hourly unified feature table: 80 columns and two targets for every point in one plan.

All optional sources are joined to the market-hour grid first; then one window
specification per point serves every lag and frame, so the table is shuffled
and sorted once for all features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.frames import ratio, rolling, series
from ..operators.dedup import keep_last

HOUR_KEY = ["delivery_date", "hour_ending"]
TEMPORAL = ["hour_of_day", "day_of_week", "month", "is_weekend", "is_peak_hour", "is_holiday", "is_summer"]
LAGS = [1, 4, 24, 168]
WINDOWS = [24, 168]
STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
PRICE_LAGS = [f"{m}_lag_{n}h" for m in ("dam", "rtm") for n in LAGS]
PRICE_ROLLS = [f"{m}_roll_{w}h_{s}" for m in ("dam", "rtm") for w in WINDOWS for s in STATS]
SPREAD = ["dam_rtm_spread", "spread_roll_24h_mean", "spread_roll_168h_mean"]
FUEL_PCT = ["wind_pct", "solar_pct", "gas_pct", "nuclear_pct", "coal_pct", "hydro_pct"]
SERVICES = ["regdn", "regup", "rrs", "nspin", "ecrs"]
ANCILLARY = SERVICES + [
    "reg_spread", "total_as_cost", "regup_lag_24h", "rrs_lag_24h", "nspin_lag_24h", "total_as_lag_24h",
    "total_as_roll_24h_mean", "total_as_roll_24h_std",
]
COMPONENTS = ["congestion_pct", "loss_pct", "energy_pct", "congestion_ma_4h", "congestion_volatility_24h", "high_congestion_flag"]
FUEL_MW = [f"{f}_gen_mw" for f in ("gas", "gas_cc", "coal", "nuclear", "solar", "wind", "hydro", "biomass")]
GENERATION = FUEL_MW + [
    "total_gen_mw", "renewable_ratio", "thermal_ratio", "net_load_mw", "solar_ramp_1h", "wind_ramp_1h", "gas_ramp_1h",
]
CROSS = ["dam_as_ratio", "reg_spread_roll_24h_mean", "ecrs_lag_24h", "gas_cc_share", "wind_ramp_4h", "solar_ramp_4h"]
FEATURES = TEMPORAL + PRICE_LAGS + PRICE_ROLLS + SPREAD + FUEL_PCT + ANCILLARY + COMPONENTS + GENERATION + CROSS
REQUIRED = TEMPORAL + PRICE_LAGS + PRICE_ROLLS + SPREAD
TARGETS = ["dam_lmp", "rtm_lmp"]


def price_grid(dam: DataFrame, rtm: DataFrame, keys: list[str]) -> DataFrame:
    """Day-ahead and real-time prices on every legal market hour of each point's date range."""
    on = [c for c in keys if c in dam.columns] + HOUR_KEY
    merged = dam.withColumnRenamed("lmp", "dam_lmp").join(rtm.withColumnRenamed("lmp", "rtm_lmp"), on)
    merged = merged.select(*keys, *HOUR_KEY, "dam_lmp", "rtm_lmp")
    days = merged.groupBy(*keys).agg(F.min("delivery_date").alias("_a"), F.max("delivery_date").alias("_b"))
    days = days.select(*keys, F.explode(F.sequence("_a", "_b")).alias("delivery_date"))
    hours = days.select(*keys, "delivery_date", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("hour_ending"))
    legal = hours.withColumn("dt", cal.market_hour_start(F.col("delivery_date"), F.col("hour_ending"))).filter("dt is not null")
    return legal.join(merged, [*keys, *HOUR_KEY], "left")


def temporal(df: DataFrame) -> DataFrame:
    day, he = F.col("delivery_date"), F.col("hour_ending")
    return df.withColumns(
        {
            "hour_of_day": he,
            "day_of_week": F.weekday(day),
            "month": F.month(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
            "is_peak_hour": he.isin(cal.PEAK_HOURS).cast("int"),
            "is_holiday": cal.major_holiday(day),
            "is_summer": F.month(day).isin(cal.SUMMER_MONTHS).cast("int"),
        }
    )


def price_lag_columns(w, cols: dict[str, str] | None = None) -> dict[str, Column]:
    cols = cols or {"dam": "dam_lmp", "rtm": "rtm_lmp"}
    return {f"{m}_lag_{n}h": F.lag(c, n).over(w) for m, c in cols.items() for n in LAGS}


def price_rolling_columns(w, cols: dict[str, str] | None = None) -> dict[str, Column]:
    cols = cols or {"dam": "dam_lmp", "rtm": "rtm_lmp"}
    return {f"{m}_roll_{n}h_{s}": rolling(fn, c, w, n, shift=1) for m, c in cols.items() for n in WINDOWS for s, fn in STATS.items()}


def spread_columns(w) -> dict[str, Column]:
    """The shifted spread; its rolling means equal means of the raw spread one row back."""
    raw = F.col("dam_lmp") - F.col("rtm_lmp")
    return {"dam_rtm_spread": F.lag(raw).over(w)} | {
        f"spread_roll_{n}h_mean": rolling(F.avg, raw, w, n, shift=1) for n in WINDOWS
    }


def ancillary_columns(w, raw: str = "raw_") -> dict[str, Column]:
    r = {s: F.col(f"{raw}{s}") for s in SERVICES}
    total = r["regdn"] + r["regup"] + r["rrs"] + r["nspin"] + r["ecrs"]
    reg = r["regup"] - r["regdn"]
    out = {s: F.lag(c).over(w) for s, c in r.items()}
    out |= {"reg_spread": F.lag(reg).over(w), "total_as_cost": F.lag(total).over(w)}
    out |= {f"{s}_lag_24h": F.lag(r[s], 24).over(w) for s in ("regup", "rrs", "nspin", "ecrs")}
    out |= {
        "total_as_lag_24h": F.lag(total, 24).over(w),
        "total_as_roll_24h_mean": rolling(F.avg, total, w, 24, shift=1),
        "total_as_roll_24h_std": rolling(F.stddev_samp, total, w, 24, shift=1),
        "reg_spread_roll_24h_mean": rolling(F.avg, reg, w, 24, shift=1),
    }
    return out


def component_columns(w, price: str = "raw_lmp", raw: str = "raw_") -> dict[str, Column]:
    cong = F.col(f"{raw}congestion")
    pct = {n: ratio(F.col(f"{raw}{n}"), F.col(price)) * 100 for n in ("congestion", "loss", "energy")}
    out = {f"{n}_pct": F.lag(c).over(w) for n, c in pct.items()}
    out |= {
        "congestion_ma_4h": rolling(F.avg, cong, w, 4, shift=1),
        "congestion_volatility_24h": rolling(F.stddev_samp, cong, w, 24, shift=1),
        "high_congestion_flag": (F.abs(F.lag(pct["congestion"]).over(w)) > 20).cast("double"),
    }
    return out


def generation_columns(w, raw: str = "raw_") -> dict[str, Column]:
    g = {c: F.col(f"{raw}{c}") for c in [*FUEL_MW, "total_gen_mw"]}
    total, wind, solar = g["total_gen_mw"], g["wind_gen_mw"], g["solar_gen_mw"]
    out = {c: F.lag(v).over(w) for c, v in g.items()}
    at = lambda c: F.lag(c).over(w)
    out |= {
        "renewable_ratio": at(ratio(wind + solar, total)),
        "thermal_ratio": at(ratio(g["gas_gen_mw"] + g["gas_cc_gen_mw"] + g["coal_gen_mw"], total)),
        "net_load_mw": at(total - wind - solar),
        "gas_cc_share": at(ratio(g["gas_cc_gen_mw"], total)),
    }
    for fuel, rows in (("solar", 1), ("wind", 1), ("gas", 1), ("wind", 4), ("solar", 4)):
        c = g[f"{fuel}_gen_mw"]
        out[f"{fuel}_ramp_{rows}h"] = F.lag(c).over(w) - F.lag(c, 1 + rows).over(w)
    return out


def _attach(grid: DataFrame, keys: list[str], source: DataFrame | None, cols: list[str], prefix: str, order: str | None = None) -> DataFrame:
    """Left join one row per market hour (last row wins); absent source or column gives NULL."""
    if source is None:
        return grid.withColumns({f"{prefix}{c}": F.lit(None).cast("double") for c in cols})
    on = [k for k in keys if k in source.columns] + HOUR_KEY
    have = [c for c in cols if c in source.columns]
    one = source.select(*on, *have, *([order] if order else []))
    if order:
        one = keep_last(one, on, [F.col(order)]).drop(order)
    one = one.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in have])
    out = grid.join(one, on, "left")
    return out.withColumns({f"{prefix}{c}": F.lit(None).cast("double") for c in cols if c not in have}) if len(have) < len(cols) else out


def unified_features(
    dam: DataFrame, rtm: DataFrame, keys: list[str], fuel_pct: DataFrame | None = None, ancillary: DataFrame | None = None,
    components: DataFrame | None = None, fuel_gen: DataFrame | None = None, load_order: str | None = None,
) -> DataFrame:
    """The full table. ``load_order`` names the column that orders repeated source rows (last wins)."""
    grid = price_grid(dam, rtm, keys)
    if fuel_pct is not None:
        fuel_pct = fuel_pct.groupBy(*HOUR_KEY).agg(*[F.avg(c).alias(c) for c in FUEL_PCT])
    grid = _attach(grid, keys, fuel_pct, FUEL_PCT, "")
    grid = _attach(grid, keys, ancillary, SERVICES, "raw_", load_order)
    grid = _attach(grid, keys, components, ["lmp", "energy", "congestion", "loss"], "raw_", load_order)
    grid = _attach(grid, keys, fuel_gen, [*FUEL_MW, "total_gen_mw"], "raw_", load_order)
    w = series(keys, "dt")
    cols = (
        price_lag_columns(w) | price_rolling_columns(w) | spread_columns(w) | ancillary_columns(w)
        | component_columns(w) | generation_columns(w)
    )
    out = temporal(grid).select("*", *[c.alias(n) for n, c in cols.items()])
    out = out.withColumn("dam_as_ratio", F.col("dam_lag_1h") / (F.abs("total_as_cost") + 1))
    return out.na.drop(subset=REQUIRED).select(*keys, *HOUR_KEY, *FEATURES, *TARGETS)
