"""Feature tables: unified hourly, spike, intraday, spread, daily, wind and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import exact_mean, series
from ..plans import daily, delta, generation, intraday, spike, unified
from . import base
from .alignment import RES15
from ..operators.ranked import in_blocks
from .registry import query
from .rules import LOCAL_CASES, MAJOR
from .sequences import J15
from .sqltext import SQLF, columns, frame, lag, lead, part, roll

# --- unified hourly table: days of the long daily series stand for hours ---------------------------------


def _as_hours(df, day="d"):
    n = F.datediff(day, F.lit("1995-01-01").cast("date"))
    out = df.withColumns({"delivery_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(n / 24)).cast("int")), "hour_ending": (n % 24 + 1).cast("int")})
    return out.drop(day)


UNIT = 0.7071067811865476
HOUR = "DATE '2024-01-01' + CAST((d - DATE '1995-01-01') // 24 AS INTEGER) AS delivery_date, (d - DATE '1995-01-01') % 24 + 1 AS hour_ending"
LINE_FUEL = {1: "gas", 2: "gas_cc", 3: "coal", 4: "nuclear", 5: "solar", 6: "wind", 7: "hydro"}


def unified_sources(spark, d):
    line = base._line(spark, d)
    dam = _as_hours(base.b_dam_d(spark, d)).withColumnRenamed("dam", "lmp")
    rtm = _as_hours(base.b_rtm_d(spark, d)).withColumnRenamed("rtm", "lmp")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    comp = line.groupBy("point", "d").agg(
        (exact_mean(price) / 997).alias("lmp"), (exact_mean(price * (1 - disc)) / 997).alias("energy"),
        (exact_mean(price * disc * 4) / 997).alias("congestion"), (exact_mean(price * tax) / 997).alias("loss"),
    )
    mw = {f: F.coalesce(F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))), F.lit(0.0)) for n, f in LINE_FUEL.items()}
    by_fuel = line.groupBy("d").agg(*[c.alias(f"{f}_gen_mw") for f, c in mw.items()], F.lit(0.0).alias("biomass_gen_mw"))
    gen = _as_hours(by_fuel.withColumn("total_gen_mw", sum((F.col(c) for c in unified.FUEL_MW), F.lit(0.0))))
    gas = F.col("gas_gen_mw") + F.col("gas_cc_gen_mw")
    pct = {f: F.try_divide(gas if f == "gas" else F.col(f"{f}_gen_mw"), F.col("total_gen_mw")) * 100 for f in ("wind", "solar", "gas", "nuclear", "coal", "hydro")}
    fuel = gen.select(*unified.HOUR_KEY, *[c.alias(f"{f}_pct") for f, c in pct.items()])
    return dam, rtm, fuel, _as_hours(base.b_asmcpc_d(spark, d)), _as_hours(comp), gen


def unified_table(spark, d):
    dam, rtm, fuel, anc, comp, gen = unified_sources(spark, d)
    return unified.unified_features(dam, rtm, ["point"], fuel, anc, comp, gen)


def _mean4(x):
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / count({x}) / 997"


base.add_cte(
    "u_gen", "SELECT *, " + " + ".join(unified.FUEL_MW) + f" AS total_gen_mw FROM (SELECT {HOUR}, " + ", ".join(
        f"coalesce(sum(l_quantity) FILTER (l_linenumber = {n}), 0) AS {f}_gen_mw" for n, f in LINE_FUEL.items())
    + ", 0 AS biomass_gen_mw FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2)",
)
base.add_cte(
    "u_comp", f"""SELECT l_returnflag AS point, {HOUR}, {_mean4("l_extendedprice")} AS raw_lmp, {_mean4("l_extendedprice * (1 - l_discount)")} AS raw_energy,
    {_mean4("l_extendedprice * l_discount * 4")} AS raw_congestion, {_mean4("l_extendedprice * l_tax")} AS raw_loss
    FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2, 3""",
)
base.add_cte("u_asm", f"SELECT {HOUR}, " + ", ".join(f"{s} AS raw_{s}" for s in unified.SERVICES) + " FROM b_asmcpc_d")
base.add_cte("u_price", f"SELECT point, {HOUR}, dam AS dam_lmp, rtm AS rtm_lmp FROM b_rtm_d JOIN b_dam_d USING (d)")
base.add_cte(
    "u_grid", f"""SELECT point, d AS delivery_date, he AS hour_ending, CASE WHEN v1 THEN u1 ELSE u0 END - INTERVAL 1 HOUR AS dt FROM (
    {LOCAL_CASES.replace(", h FROM", ", he, point FROM")} (SELECT point, d, he, CAST(d AS TIMESTAMP) + to_hours(he % 24) AS l FROM (SELECT point,
    CAST(unnest(generate_series(min(delivery_date), max(delivery_date), INTERVAL 1 DAY)) AS DATE) AS d FROM u_price GROUP BY 1), range(1, 25) AS r(he))) WHERE v0 OR v1""",
)
_TOTAL = "nullif(total_gen_mw, 0)"
base.add_cte(
    "u_raw", "SELECT g.*, dam_lmp, rtm_lmp, " + ", ".join(f"raw_{c}" for c in ["lmp", "energy", "congestion", "loss", *unified.SERVICES])
    + ", " + ", ".join(f"{c} AS raw_{c}" for c in [*unified.FUEL_MW, "total_gen_mw"]) + ", " + ", ".join(
        f"{'(gas_gen_mw + gas_cc_gen_mw)' if f == 'gas' else f + '_gen_mw'} / {_TOTAL} * 100 AS {f}_pct" for f in ("wind", "solar", "gas", "nuclear", "coal", "hydro"))
    + """ FROM u_grid g LEFT JOIN u_price USING (point, delivery_date, hour_ending) LEFT JOIN u_comp USING (point, delivery_date, hour_ending)
    LEFT JOIN u_asm USING (delivery_date, hour_ending) LEFT JOIN u_gen USING (delivery_date, hour_ending)""",
)

MKT = {"dam": "dam_lmp", "rtm": "rtm_lmp"}
UL = {f"{m}_lag_{n}h": lag(c, n, o="dt") for m, c in MKT.items() for n in unified.LAGS}
UR = {f"{m}_roll_{n}h_{s}": roll(SQLF[s], c, n, 1, o="dt") for m, c in MKT.items() for n in unified.WINDOWS for s in unified.STATS}
_SPR = "(dam_lmp - rtm_lmp)"
US = {"dam_rtm_spread": lag(_SPR, o="dt")} | {f"spread_roll_{n}h_mean": roll("avg", _SPR, n, 1, o="dt") for n in unified.WINDOWS}
_TAS, _REG = "(raw_regdn + raw_regup + raw_rrs + raw_nspin + raw_ecrs)", "(raw_regup - raw_regdn)"
UA = {s: lag(f"raw_{s}", o="dt") for s in unified.SERVICES} | {"reg_spread": lag(_REG, o="dt"), "total_as_cost": lag(_TAS, o="dt")}
UA |= {f"{s}_lag_24h": lag(f"raw_{s}", 24, o="dt") for s in ("regup", "rrs", "nspin", "ecrs")}
UA |= {
    "total_as_lag_24h": lag(_TAS, 24, o="dt"), "total_as_roll_24h_mean": roll("avg", _TAS, 24, 1, o="dt"),
    "total_as_roll_24h_std": roll("stddev_samp", _TAS, 24, 1, o="dt"), "reg_spread_roll_24h_mean": roll("avg", _REG, 24, 1, o="dt"),
}
UC = {f"{n}_pct": lag(f"(raw_{n} / nullif(raw_lmp, 0) * 100)", o="dt") for n in ("congestion", "loss", "energy")}
UC |= {
    "congestion_ma_4h": roll("avg", "raw_congestion", 4, 1, o="dt"), "congestion_volatility_24h": roll("stddev_samp", "raw_congestion", 24, 1, o="dt"),
    "high_congestion_flag": f"CAST(abs({lag('(raw_congestion / nullif(raw_lmp, 0) * 100)', o='dt')}) > 20 AS DOUBLE)",
}
_G = lambda f: f"raw_{f}_gen_mw"
_T = "nullif(raw_total_gen_mw, 0)"
UG = {c: lag(f"raw_{c}", o="dt") for c in [*unified.FUEL_MW, "total_gen_mw"]}
UG |= {
    "renewable_ratio": lag(f"(({_G('wind')} + {_G('solar')}) / {_T})", o="dt"),
    "thermal_ratio": lag(f"(({_G('gas')} + {_G('gas_cc')} + {_G('coal')}) / {_T})", o="dt"),
    "net_load_mw": lag(f"(raw_total_gen_mw - {_G('wind')} - {_G('solar')})", o="dt"),
    "gas_cc_share": lag(f"({_G('gas_cc')} / {_T})", o="dt"),
}
for _f, _n in (("solar", 1), ("wind", 1), ("gas", 1), ("wind", 4), ("solar", 4)):
    UG[f"{_f}_ramp_{_n}h"] = f"{lag(_G(_f), 1, o='dt')} - {lag(_G(_f), 1 + _n, o='dt')}"
UX = {"dam_as_ratio": f"{UL['dam_lag_1h']} / (abs({UA['total_as_cost']}) + 1)"}
UT = {
    "hour_of_day": "hour_ending", "day_of_week": "isodow(delivery_date) - 1", "month": "month(delivery_date)",
    "is_weekend": "CAST(isodow(delivery_date) >= 6 AS INTEGER)", "is_peak_hour": "CAST(hour_ending BETWEEN 7 AND 22 AS INTEGER)",
    "is_holiday": "CAST(" + MAJOR.replace("(d)", "(delivery_date)") + " AS INTEGER)", "is_summer": "CAST(month(delivery_date) BETWEEN 6 AND 9 AS INTEGER)",
}


def _u(cols):
    return f"SELECT point, delivery_date, hour_ending, {columns(cols)} FROM u_raw"


def _unified_part(key, cols):
    """One column group of the unified table over the whole grid (rows of short history included)."""

    @query(key, text="point", dates="delivery_date", ints="hour_ending", nums=" ".join(cols), sql=_u(cols))
    def run(spark, d, group=key):
        dam, rtm, _, anc, comp, gen = unified_sources(spark, d)
        g = unified.price_grid(dam, rtm, ["point"])
        w = series("point", "dt")
        if group in ("ancillary_features", "cross_domain"):
            g = unified._attach(g, ["point"], anc, unified.SERVICES, "raw_")
        if group == "congestion_features":
            g = unified._attach(g, ["point"], comp, ["lmp", "energy", "congestion", "loss"], "raw_")
        if group == "generation_features":
            g = unified._attach(g, ["point"], gen, [*unified.FUEL_MW, "total_gen_mw"], "raw_")
        if group == "cross_domain":
            both = unified.price_lag_columns(w) | unified.ancillary_columns(w)
            g = g.select("*", *[both[c].alias(c) for c in ("dam_lag_1h", "total_as_cost")])
            return g.withColumn("dam_as_ratio", F.col("dam_lag_1h") / (F.abs("total_as_cost") + 1))
        made = {
            "price_lags": unified.price_lag_columns, "price_rolling": unified.price_rolling_columns, "spread_rolling": unified.spread_columns,
            "ancillary_features": unified.ancillary_columns, "congestion_features": unified.component_columns, "generation_features": unified.generation_columns,
        }[group](w)
        return g.select("*", *[c.alias(n) for n, c in made.items()])

    return run


price_lags = _unified_part("price_lags", UL)
price_rolling = _unified_part("price_rolling", UR)
spread_rolling = _unified_part("spread_rolling", US)
ancillary_features = _unified_part("ancillary_features", UA)
congestion_features = _unified_part("congestion_features", UC)
generation_features = _unified_part("generation_features", UG)
cross_domain = _unified_part("cross_domain", UX)

_ALL = UT | UL | UR | US | {c: c for c in unified.FUEL_PCT} | UA | UC | UG | UX
_INT = [c for c in unified.TEMPORAL if c != "hour_of_day"]


@query(
    "unified_features", text="point", dates="delivery_date", ints="hour_ending hour_of_day " + " ".join(_INT),
    nums=" ".join([c for c in unified.FEATURES if c not in unified.TEMPORAL] + unified.TARGETS),
    sql=f"SELECT * FROM (SELECT point, delivery_date, dam_lmp, rtm_lmp, hour_ending, {columns(_ALL)} FROM u_raw) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in unified.REQUIRED),
)
def unified_features(spark, d):
    return unified_table(spark, d)


RTM24 = f"SELECT point, t, price, {columns({'rtm_lag_1h': lag('price', 1), 'rtm_lag_4h': lag('price', 4), 'rtm_lag_24h': lag('price', 24)})}, " + ", ".join(
    f"{roll(SQLF[s], 'price', 24, 1)} AS rtm_roll_24h_{s}" for s in SQLF) + " FROM (SELECT point, t, price * 0.7071067811865476 AS price FROM b_rtm1h)"


def _rtm24(spark, d):
    w = series("point")
    cols = unified.price_lag_columns(w, {"rtm": "price"}) | unified.price_rolling_columns(w, {"rtm": "price"})
    keep = [c for c in cols if "168" not in c]
    r = base.b_rtm1h(spark, d).withColumn("price", F.col("price") * UNIT)
    return r.select("point", "t", "price", *[cols[c].alias(c) for c in keep])


@query(
    "spike_regime_features", text="point", times="t", nums="price_accel volatility_regime price_momentum price_ratio_to_mean rtm_range_24h spread_late",
    sql=f"""SELECT point, t, (rtm_lag_1h - rtm_lag_4h) - (rtm_lag_4h - rtm_lag_24h) AS price_accel, coalesce(rtm_roll_24h_std / nullif(abs(rtm_roll_24h_mean), 0), 0)
      AS volatility_regime, rtm_lag_1h - rtm_roll_24h_mean AS price_momentum, coalesce(rtm_lag_1h / nullif(rtm_roll_24h_mean, 0), 1) AS price_ratio_to_mean,
      rtm_roll_24h_max - rtm_roll_24h_min AS rtm_range_24h, {lag("price", 2)} AS spread_late FROM ({RTM24})""",
)
def spike_regime_features(spark, d):
    r = _rtm24(spark, d).withColumn("spread_late", F.lag("price").over(series("point")))
    return spike.regime_features(spike.shift_leaking(r, ["point"], "t", ["spread_late"]))


@query(
    "rtm_derived", text="point", times="t", nums="rtm_volatility rtm_momentum rtm_mean_reversion rtm_volatility_serving",
    sql=f"""SELECT point, t, rtm_roll_24h_std / (abs(rtm_roll_24h_mean) + 1) AS rtm_volatility, rtm_lag_1h - rtm_lag_4h AS rtm_momentum,
      rtm_lag_1h - rtm_roll_24h_mean AS rtm_mean_reversion, rtm_roll_24h_std / nullif(rtm_roll_24h_mean + 1, 0) AS rtm_volatility_serving FROM ({RTM24})""",
)
def rtm_derived(spark, d):
    r = intraday.rtm_derived(_rtm24(spark, d), absolute_mean=False).withColumnRenamed("rtm_volatility", "rtm_volatility_serving")
    return intraday.rtm_derived(r)


# --- spike features -------------------------------------------------------------------------------------


def _price_sql(c):
    return {
        "lmp_lag1": lag(c, 1), "lmp_lag4": lag(c, 4), "lmp_lag96": lag(c, 96), "lmp_mean_4": roll("avg", c, 4, 1, 1), "lmp_mean_96": roll("avg", c, 96, 1, 1),
        "lmp_std_96": roll("stddev_samp", c, 96, 1, 1), "lmp_max_96": roll("max", c, 96, 1, 1), "lmp_ramp_1h": f"{lag(c, 1)} - {lag(c, 5)}",
        "lmp_ramp_4h": f"{lag(c, 1)} - {lag(c, 17)}",
    }


def _spread_sql(c):
    return {
        "spread_lag1": lag(c, 1), "spread_mean_4": roll("avg", c, 4, 1, 1), "spread_max_96": roll("max", c, 96, 1, 1), "spread_ramp_1h": f"{lag(c, 1)} - {lag(c, 5)}",
    }


def _chill(t, v):
    return f"""CASE WHEN {t} < 10 AND {v} > 4.8 THEN 13.12 + 0.6215 * {t} - 11.37 * pow(greatest({v}, 4.8), 0.16) + 0.3965 * {t} * pow(greatest({v}, 4.8), 0.16) ELSE {t} END"""


def _weather_sql(t, v, p="point"):
    return {
        "temp_2m": t, "wind_speed_10m": v, "temp_anomaly": f"{t} - {roll('avg', t, 2880, 0, 96, p=p)}", "temp_delta_1h": f"{t} - {lag(t, 4, p=p)}",
        "wind_chill": _chill(t, v),
    }


# values are in another unit so that no mean ends exactly halfway between two printed values
S15 = "SELECT point, t, lmp * 0.7071067811865476 AS lmp, hub * 0.7071067811865476 AS hub, spread * 0.7071067811865476 AS spread FROM (" + J15 + ")"


def s15(spark, d):
    from .sequences import j15

    return j15(spark, d).withColumns({c: F.col(c) * UNIT for c in ("lmp", "hub", "spread")})


@query("spike_price_features", text="point", times="t", nums=" ".join(spike.PRICE), sql=f"SELECT point, t, {columns(_price_sql('lmp'))} FROM ({S15})")
def spike_price_features(spark, d):
    r = base.b_rtm15(spark, d).withColumn("lmp", F.col("price") * UNIT)
    return r.select("point", "t", *[c.alias(n) for n, c in spike.price_columns(series("point")).items()])


@query("spike_spread_features", text="point", times="t", nums=" ".join(spike.SPREAD), sql=f"SELECT point, t, {columns(_spread_sql('spread'))} FROM ({S15})")
def spike_spread_features(spark, d):
    return s15(spark, d).select("point", "t", *[c.alias(n) for n, c in spike.spread_columns(series("point")).items()])


@query("spike_weather_features", text="station", times="t", nums=" ".join(spike.WEATHER),
       sql=f"SELECT station, t, {columns(_weather_sql('temp', 'wind', 'station'))} FROM (SELECT station, t, temp * 0.7071067811865476 AS temp, wind FROM b_wx)")
def spike_weather_features(spark, d):
    wx = base.b_wx(spark, d).withColumn("temp", F.col("temp") * UNIT)
    return wx.select("station", "t", *[c.alias(n) for n, c in spike.weather_columns(series("station")).items()])


STATION = "CASE point WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE 'error' END"
MATRIX = f"""SELECT b.point, b.t, l.spike_event, l.lead_spike_60, l.regime, l.spread, b.lmp, dm.dam, w.temp, w.wind, r.prc, r.lam, r.adder, g.gen, g.stwpf
   FROM (SELECT *, {STATION} AS station FROM ({S15})) b LEFT JOIN (SELECT point, t, spread, lmp > 30 AS spike_event, lmp > 25 AS lead_spike_60,
   CASE WHEN lmp > 30 THEN 'Scarcity' ELSE 'Normal' END AS regime FROM ({S15}) WHERE lmp > 4) l ON l.point = b.point AND l.t = b.t
   ASOF LEFT JOIN (SELECT point, t, price * 0.7071067811865476 AS dam FROM b_rtm1h) dm ON dm.point = b.point AND b.t >= dm.t
   ASOF LEFT JOIN (SELECT station, t + INTERVAL 1 HOUR AS t, temp * 0.7071067811865476 AS temp, wind FROM b_wx) w ON w.station = b.station AND b.t >= w.t
   ASOF LEFT JOIN ({RES15}) r ON b.t >= r.t ASOF LEFT JOIN b_gen g ON b.t >= g.t"""
_FILL = spike.WEATHER + spike.RESERVE + spike.WIND
_MX = _price_sql("lmp") | _spread_sql("spread") | {"dam_lmp_current_hour": "dam", "dam_rtm_gap": lag("(dam - lmp)")} | _weather_sql("temp", "wind")
_MX |= {
    "prc_lag1": lag("prc"), "prc_mean_1h": roll("avg", "prc", 4, 1, 1), "prc_ramp_1h": f"{lag('prc', 1)} - {lag('prc', 5)}", "system_lambda_lag1": lag("lam"),
    "rtordpa_lag1": lag("adder"), "wind_gen_lag1": lag("gen"), "wind_forecast_error": lag("(gen - stwpf)"),
}
_LOC = "(t AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago')"


@query(
    "spike_feature_matrix", text="point regime", times="t", ints="spike_event lead_spike_60 hour_of_day day_of_week month is_weekend",
    nums=" ".join(c for c in spike.FEATURES if c not in spike.TEMPORAL),
    sql=f"""SELECT * EXCLUDE ({", ".join(_FILL)}), hour({_LOC}) AS hour_of_day, isodow({_LOC}) - 1 AS day_of_week, month({_LOC}) AS month, isodow({_LOC}) >= 6 AS is_weekend, """
    + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY point ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS {c}" for c in _FILL)
    + f" FROM (SELECT point, t, spike_event, lead_spike_60, regime, {columns(_MX)} FROM ({MATRIX}))",
)
def spike_feature_matrix(spark, d):
    s = s15(spark, d)
    lmp = F.col("lmp")
    labels = s.filter(lmp > 4).select(
        "point", "t", "spread", (lmp > 30).alias("spike_event"), (lmp > 25).alias("lead_spike_60"), F.when(lmp > 30, "Scarcity").otherwise("Normal").alias("regime")
    )
    stations = spark.createDataFrame([("click", "view"), ("view", "click"), ("error", "error"), ("purchase", "error"), ("signup", "error")], "point STRING, station STRING")
    dam = base.b_rtm1h(spark, d).select("point", "t", (F.col("price") * UNIT).alias("dam"))
    wx = base.b_wx(spark, d).withColumn("temp", F.col("temp") * UNIT)
    return spike.feature_matrix(s.select("point", "t", "lmp"), labels, dam, wx, stations, base.b_res(spark, d), base.b_gen(spark, d))


_ZW = {
    "t_anom": "CASE WHEN temp IS NOT NULL THEN temp - avg(temp) OVER (PARTITION BY station, hour(t) ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END",
    "delta_t_1h": f"temp - {lag('temp', 1, p='station')}", "delta_t_3h": f"temp - {lag('temp', 3, p='station')}",
    "wind_chill": """CASE WHEN temp < 10 AND wind > 4.8 THEN (35.74 + 0.6215 * (temp * 9 / 5 + 32) - 35.75 * pow(wind * 0.621371, 0.16)
    + 0.4275 * (temp * 9 / 5 + 32) * pow(wind * 0.621371, 0.16) - 32) * 5 / 9 ELSE temp END""",
    "cold_front": f"CASE WHEN temp - {lag('temp', 3, p='station')} < -5 AND (wdir >= 315 OR wdir <= 45) THEN 1 ELSE 0 END",
}


@query(
    "zone_weather_features", text="station", times="t", nums="t_anom delta_t_1h delta_t_3h wind_chill", ints="cold_front",
    sql="SELECT station, t, " + ", ".join(f"{lag(c, p='station')} AS {c}" for c in _ZW) + f""" FROM (SELECT station, t, {columns(_ZW)} FROM (SELECT g.station, g.t,
      temp * 0.7071067811865476 AS temp, wind, wdir FROM (SELECT station, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM b_wx GROUP BY 1) g
      LEFT JOIN b_wx USING (station, t)))""",
)
def zone_weather_features(spark, d):
    return spike.zone_weather(base.b_wx(spark, d).withColumn("temp", F.col("temp") * UNIT))


@query(
    "price_structure_features", text="point", times="t",
    nums="spread_hub spread_rt_da price_ramp_5m price_ramp_15m price_accel cross_spread cross_spread_ramp",
    sql=f"""SELECT *, price_ramp_5m - {lag("price_ramp_5m")} AS price_accel, cross_spread - {lag("cross_spread")} AS cross_spread_ramp FROM (SELECT b.point, b.t,
      price - hub AS spread_hub, price - dam AS spread_rt_da, (price - {lag("price", 1, "b.point", "b.t")}) / 5 AS price_ramp_5m,
      (price - {lag("price", 3, "b.point", "b.t")}) / 15 AS price_ramp_15m, price - other AS cross_spread FROM (SELECT *, date_trunc('hour', t) AS h FROM b_rtm5) b
      JOIN b_hub5 USING (t) LEFT JOIN (SELECT t AS h, hub AS dam FROM b_hub1h) x ON x.h = b.h LEFT JOIN (SELECT t AS h, price AS other FROM b_rtm1h WHERE point = 'view') y ON y.h = b.h)""",
)
def price_structure_features(spark, d):
    h = F.date_trunc("hour", "t")
    r = base.b_rtm5(spark, d).join(base.b_hub5(spark, d), "t").withColumn("h", h)
    r = r.join(base.b_hub1h(spark, d).select(F.col("t").alias("h"), F.col("hub").alias("dam")), "h", "left")
    other = base.b_rtm1h(spark, d).filter("point = 'view'").select(F.col("t").alias("h"), F.col("price").alias("other"))
    return spike.price_structure(r.join(other, "h", "left"), ["point"])


def supply(spark, d):
    e = base.b_ev(spark, d).withColumn("t", F.window("ts", "5 minutes")["start"])
    total = lambda p, m=1.0: F.coalesce(F.sum(F.when(F.col("point") == p, F.col("k"))), F.lit(0.0)) * m
    return e.groupBy("t").agg(
        (F.sum("k") * 3).alias("load"), total("click").alias("wind"), total("view").alias("solar"), total("error").alias("gas"),
        total("signup").alias("coal"), (F.sum(F.col("k") - 50)).alias("esr"),
    ).withColumn("sys", F.lit("all"))


SUPPLY = """SELECT 'all' AS point, time_bucket(INTERVAL '5 minutes', ts) AS t, sum(k) * 3 AS load, coalesce(sum(k) FILTER (point = 'click'), 0) AS wind,
   coalesce(sum(k) FILTER (point = 'view'), 0) AS solar, coalesce(sum(k) FILTER (point = 'error'), 0) AS gas, coalesce(sum(k) FILTER (point = 'signup'), 0) AS coal,
   sum(k - 50) AS esr FROM b_ev GROUP BY 2"""
_SD = {
    "net_load": "nl", "net_load_ramp_5m": f"nl - {lag('nl')}", "net_load_ramp_15m": f"nl - {lag('nl', 3)}", "net_load_accel": f"(nl - {lag('nl')}) - ({lag('nl')} - {lag('nl', 2)})",
    "wind_anomaly": f"(wind - {roll('avg', 'wind', 8640, 0, 1)}) / ({roll('stddev_samp', 'wind', 8640, 0, 1)} + 1e-6)", "wind_ramp": f"wind - {lag('wind')}",
    "wind_ramp_15m": f"wind - {lag('wind', 3)}", "gas_saturation": f"gas / (quantile_cont(gas, 0.95) OVER {frame(2016)} + 1e-6)", "coal_ramp": f"coal - {lag('coal')}",
    "solar_ramp": f"solar - {lag('solar')}", "solar_ramp_15m": f"solar - {lag('solar', 3)}",
}


@query(
    "supply_demand_features", times="t", nums=" ".join(_SD), ints="coal_stress esr_is_charging esr_is_discharging",
    sql=f"""SELECT t, {columns(_SD)}, coalesce(coal > {lag("coal")} AND hour(t) < 6, false) AS coal_stress, esr < 0 AS esr_is_charging, esr > 0 AS esr_is_discharging
      FROM (SELECT *, load - wind - solar AS nl FROM ({SUPPLY}))""",
)
def supply_demand_features(spark, d):
    return spike.supply_demand(supply(spark, d), ["sys"])


# --- intraday ---------------------------------------------------------------------------------------------

P15 = "SELECT point, t, price * 0.7071067811865476 AS price FROM b_rtm15"


def p15(spark, d):
    return base.b_rtm15(spark, d).withColumn("price", F.col("price") * UNIT)


_L15 = {f"price_lag_{n}": lag("price", n) for n in (1, 2, 3, 4, 96, 672)} | {
    "price_lag_4_diff_lag_96": f"{lag('price', 4)} - {lag('price', 96)}", "price_lag_672_diff_lag_96": f"{lag('price', 672)} - {lag('price', 96)}",
}


@query("rtm15_lags", text="point", times="t", nums=" ".join(_L15), sql=f"SELECT point, t, {columns(_L15)} FROM ({P15})")
def rtm15_lags(spark, d):
    return intraday.lags(p15(spark, d), ["point"])


_HL = {f"price_lag_{n}": lag("price", max(n, 3)) for n in (1, 2, 3, 4)} | {f"price_lag_{n}": lag("price", n) for n in (96, 192, 288, 672, 1344, 35040)}


@query("rtm15_horizon_lags", text="point", times="t", nums=" ".join(_HL), sql=f"SELECT point, t, {columns(_HL)} FROM ({P15})")
def rtm15_horizon_lags(spark, d):
    return intraday.horizon_lags(p15(spark, d), ["point"], 3)


_R15 = {f"price_{s}_{n}": roll(SQLF[s], "price", r, 0, m) for n, r, m, ss in (
    ("1h", 4, 1, SQLF), ("3h", 12, 4, ("mean", "std")), ("24h", 96, 24, SQLF), ("7d", 672, 168, ("mean", "std"))) for s in ss}
_R15["price_skew_24h"] = roll("skewness", "price", 96, 0, 24)


@query("rtm15_rolling", text="point", times="t", nums=" ".join(_R15), sql=f"SELECT point, t, {columns(_R15)} FROM ({P15})")
def rtm15_rolling(spark, d):
    return intraday.rolling_stats(p15(spark, d), ["point"])


_RM = {}
for _n, _r in (("6h", 24), ("24h", 96), ("7d", 672), ("14d", 1344)):
    _RM |= {f"price_median_{_n}": roll("median", "price", _r, 2, _r // 2), f"price_skew_{_n}": roll("skewness", "price", _r, 2, _r // 2)}
    _RM[f"price_range_{_n}"] = f"{roll('max', 'price', _r, 2, _r // 2)} - {roll('min', 'price', _r, 2, _r // 2)}"


@query("rolling_median", text="point", times="t", nums=" ".join(_RM), sql=f"SELECT point, t, {columns(_RM)} FROM ({P15})")
def rolling_median(spark, d):
    return intraday.horizon_rolling(p15(spark, d), ["point"], 2, ["6h", "24h", "7d", "14d"])


def _avg_lags(steps):
    vals = [lag("price", n) for n in steps]
    return f"list_avg([{', '.join(vals)}])"


@query(
    "same_time_mean", text="point", times="t", nums="same_time_mean same_time_dow_mean same_time_mean_7d same_time_dow_mean_4w same_time_dow_std_4w",
    sql=f"""SELECT point, t, {_avg_lags([96 * i for i in range(1, 8)])} AS same_time_mean, {_avg_lags([672 * i for i in range(1, 5)])} AS same_time_dow_mean,
      avg(price) OVER (PARTITION BY point, hour(t), minute(t) ORDER BY t ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS same_time_mean_7d,
      avg(price) OVER (PARTITION BY point, hour(t), minute(t), isodow(t) ORDER BY t ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS same_time_dow_mean_4w,
      stddev_samp(price) OVER (PARTITION BY point, hour(t), minute(t), isodow(t) ORDER BY t ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS same_time_dow_std_4w FROM ({P15})""",
)
def same_time_mean(spark, d):
    return intraday.same_slot_history(intraday.same_time_means(p15(spark, d), ["point"]), ["point"], 2)


_M1, _S1 = roll("avg", "price", 4, 0, 1), roll("stddev_samp", "price", 4, 0, 1)
_M24, _S24 = roll("avg", "price", 96, 0, 24), roll("stddev_samp", "price", 96, 0, 24)
_MOM = {f"price_diff_{n}": f"price - {lag('price', n)}" for n in (1, 4, 96)} | {
    "price_pct_1": f"(price - {lag('price')}) / nullif({lag('price')}, 0)", "price_momentum_1h": f"(price - {_M1}) / ({_S1} + 1e-6)",
    "price_momentum_24h": f"(price - {_M24}) / ({_S24} + 1e-6)", "price_vs_mean_24h": f"price / ({_M24} + 1e-6)",
    "price_acceleration": f"(price - {lag('price')}) - ({lag('price')} - {lag('price', 2)})",
}


@query("momentum_features", text="point", times="t", nums=" ".join(_MOM), sql=f"SELECT point, t, {columns(_MOM)} FROM ({P15})")
def momentum_features(spark, d):
    return intraday.momentum(p15(spark, d), ["point"])


_SC = {}
for _l in (20, 30, 50):
    _SC |= {
        f"is_spike_{_l}": f"price > {_l}", f"spike_count_24h_{_l}": f"sum(CAST(price > {_l} AS INTEGER)) OVER {frame(96)}",
        f"spike_count_7d_{_l}": f"sum(CAST(price > {_l} AS INTEGER)) OVER {frame(672)}",
    }
_MX24, _MN24 = roll("max", "price", 96, 0, 24), roll("min", "price", 96, 0, 24)
_SX = {"price_vs_max_24h": f"price / ({_MX24} + 1e-6)", "price_vs_min_24h": f"price / ({_MN24} + 1e-6)", "price_range_24h": f"{_MX24} - {_MN24}"}


@query("spike_counts", text="point", times="t", ints=" ".join(_SC), nums=" ".join(_SX), sql=f"SELECT point, t, {columns(_SC | _SX)} FROM ({P15})")
def spike_counts(spark, d):
    return intraday.spike_counts(p15(spark, d), ["point"], [20, 30, 50])


@query(
    "rolling_percent_rank", text="point", times="t", nums="share_below rank_pct",
    sql=f"""SELECT point, t, CASE WHEN len(l) >= 24 THEN coalesce(CAST(lt AS DOUBLE) / nullif(len(l) - 1, 0), 0.5) END AS share_below,
      CASE WHEN len(l) >= 96 THEN (lt + (eq + 1) / CAST(2 AS DOUBLE)) / len(l) END AS rank_pct FROM (SELECT *, len(list_filter(l, lambda x: x < price)) AS lt,
      len(list_filter(l, lambda x: x = price)) AS eq FROM (SELECT *, list(price) OVER {frame(96)} AS l FROM ({P15})))""",
)
def rolling_percent_rank(spark, d):
    return intraday.percent_rank(p15(spark, d), ["point"])


@query(
    "volatility_features", text="point", times="t", nums="cv_24h amplitude_1h volatility_change recent_volatility_ratio",
    sql=f"""SELECT *, s1 - {lag("s1", 4)} AS volatility_change, s1 / (s24 + 1e-6) AS recent_volatility_ratio FROM (SELECT point, t, {_S1} AS s1, {_S24} AS s24,
      {_S24} / ({_M24} + 1e-6) AS cv_24h, {roll("max", "price", 4, 0, 1)} - {roll("min", "price", 4, 0, 1)} AS amplitude_1h FROM ({P15}))""",
)
def volatility_features(spark, d):
    return intraday.volatility(p15(spark, d), ["point"])


@query(
    "horizon_features", text="point", times="t", ints="target_hour target_minute target_is_peak crosses_hour horizon_minutes",
    sql="""SELECT point, t, hour(g) AS target_hour, minute(g) AS target_minute, hour(g) BETWEEN 7 AND 22 AS target_is_peak, hour(t) <> hour(g) AS crosses_hour,
      45 AS horizon_minutes FROM (SELECT *, t + INTERVAL 45 MINUTE AS g FROM b_rtm15)""",
)
def horizon_features(spark, d):
    return intraday.horizon_flags(base.b_rtm15(spark, d), 3)


_DT = {
    "rtm_dam_spread": "sp", "spread_mean_1h": roll("avg", "sp", 4, 0, 1), "spread_mean_24h": roll("avg", "sp", 96, 0, 24), "spread_std_24h": roll("stddev_samp", "sp", 96, 0, 24),
    "rtm_dam_ratio": "price / nullif(c + 1, 0)", "dam_price_current": "c", "dam_price_target": "g", "dam_change": "g - c", "dam_change_pct": "(g - c) / nullif(c + 1, 0)",
    "dam_target_zscore": f"(g - {roll('avg', 'c', 96, 0, 24)}) / ({roll('stddev_samp', 'c', 96, 0, 24)} + 1)",
}


@query(
    "dam_target_features", text="point", times="t", nums=" ".join(_DT), ints="dam_target_above_100 dam_target_above_200",
    sql=f"""SELECT point, t, {columns(_DT)}, coalesce(g > 100, false) AS dam_target_above_100, coalesce(g > 200, false) AS dam_target_above_200 FROM (
      SELECT p.*, a.hub * 0.7071067811865476 AS c, b.hub * 0.7071067811865476 AS g, price - a.hub * 0.7071067811865476 AS sp FROM ({P15}) p LEFT JOIN b_hub1h a ON a.t = date_trunc('hour', p.t)
      LEFT JOIN b_hub1h b ON b.t = date_trunc('hour', p.t + INTERVAL 60 MINUTE))""",
)
def dam_target_features(spark, d):
    dam = base.b_hub1h(spark, d).select("t", (F.col("hub") * UNIT).alias("dam"))
    return intraday.dam_context(p15(spark, d), dam, ["point"], 4)


# --- spread and day-ahead samples ---------------------------------------------------------------------------

HOURLY = """SELECT point, h AS t, CAST(h AS DATE) AS d, hour(h) AS hour, rtm_mean, rtm_max, rtm_std, hub * 0.7071067811865476 AS dam_price, rtm_mean - hub * 0.7071067811865476 AS spread, rtm_last - hub * 0.7071067811865476 AS spread_last
   FROM (SELECT point, date_trunc('hour', t) AS h, avg(price * 0.7071067811865476) AS rtm_mean, max(price * 0.7071067811865476) AS rtm_max, stddev_samp(price * 0.7071067811865476) AS rtm_std, arg_max(price * 0.7071067811865476, t) AS rtm_last
   FROM b_rtm15 GROUP BY 1, 2) JOIN b_hub1h ON b_hub1h.t = h"""


def hourly(spark, d):
    q = p15(spark, d)
    h = q.groupBy("point", F.date_trunc("hour", "t").alias("t")).agg(
        F.avg("price").alias("rtm_mean"), F.max("price").alias("rtm_max"), F.stddev_samp("price").alias("rtm_std"), F.max_by("price", "t").alias("rtm_last")
    )
    h = h.join(base.b_hub1h(spark, d).select("t", (F.col("hub") * UNIT).alias("dam_price")), "t")
    return h.withColumns(
        {
            "d": F.col("t").cast("date"), "hour": F.hour("t"), "spread": F.col("rtm_mean") - F.col("dam_price"), "spread_last": F.col("rtm_last") - F.col("dam_price"),
        }
    )


_SH = {f"spread_lag_{n}h": lag("spread", n) for n in (24, 48, 72, 168)}
for _n, _c in (("spread", "spread"), ("rtm", "rtm_mean"), ("dam", "dam_price")):
    _SH |= {f"{_n}_mean_24h": roll("avg", _c, 24), f"{_n}_mean_7d": roll("avg", _c, 168), f"{_n}_std_24h": roll("stddev_samp", _c, 24)}
_SH |= {f"spread_{s}_7d": roll(SQLF[s], "spread", 168) for s in ("std", "max", "min")}
_SHI = {"spike_count_24h": roll("sum", "CAST(abs(spread) > 20 AS INTEGER)", 24), "rtm_spike_count_24h": roll("sum", "CAST(rtm_mean > 100 AS INTEGER)", 24)}


@query("spread_history", text="point", times="t", nums=" ".join(_SH), ints=" ".join(_SHI), sql=f"SELECT point, t, {columns(_SH | _SHI)} FROM ({HOURLY})")
def spread_history(spark, d):
    return delta.spread_history(hourly(spark, d), ["point"])


_F168, _F24 = frame(168), frame(24)
_SNAP = {
    "spread_mean_7d": f"avg(spread) OVER {_F168}", "spread_std_7d": f"stddev_samp(spread) OVER {_F168}", "spread_max_7d": f"max(spread) OVER {_F168}",
    "spread_min_7d": f"min(spread) OVER {_F168}", "spread_median_7d": f"median(spread) OVER {_F168}", "spread_mean_24h": f"avg(spread) OVER {_F24}",
    "spread_std_24h": f"stddev_samp(spread) OVER {_F24}", "rtm_mean_7d": f"avg(rtm_mean) OVER {_F168}", "rtm_std_7d": f"stddev_samp(rtm_mean) OVER {_F168}",
    "rtm_max_7d": f"max(rtm_max) OVER {_F168}", "rtm_mean_24h": f"avg(rtm_mean) OVER {_F24}", "rtm_volatility_24h": f"avg(rtm_std) OVER {_F24}",
    "dam_mean_7d": f"avg(dam_price) OVER {_F168}", "dam_std_7d": f"stddev_samp(dam_price) OVER {_F168}", "dam_mean_24h": f"avg(dam_price) OVER {_F24}",
    "spread_positive_ratio_7d": f"avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) OVER {_F168}", "spread_positive_ratio_24h": f"avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) OVER {_F24}",
    "spread_trend_7d": f"avg(spread) OVER {_F24} - avg(spread) OVER (PARTITION BY point ORDER BY t ROWS BETWEEN 167 PRECEDING AND 144 PRECEDING)",
}
_SNAPI = {"spike_count_7d": f"sum(CAST(abs(spread) > 20 AS INTEGER)) OVER {_F168}", "rtm_spike_count_7d": f"sum(CAST(rtm_mean > 100 AS INTEGER)) OVER {_F168}"}
_HIST = {
    "spread_same_hour_hist": "avg(spread) OVER h", "spread_same_hour_std": "stddev_samp(spread) OVER h", "rtm_same_hour_hist": "avg(rtm_mean) OVER h",
    "spread_same_dow_hour": "avg(spread) OVER w", "spread_same_dow_hour_last": "last_value(spread) OVER w",
}
_DREL = ["dam_vs_7d_mean", "dam_percentile_7d", "dam_vs_same_hour"]


@query(
    "delta_samples", text="point", times="t", nums=" ".join([*_SNAP, *_HIST, *_DREL]), ints=" ".join(_SNAPI) + " target_class target_is_peak dam_price_level",
    sql=f"""WITH x AS ({HOURLY}), snap AS (SELECT * FROM (SELECT point, d AS d0, {lead("d")} AS d, {columns(_SNAP | _SNAPI)}, list(dam_price) OVER {_F168} AS dams,
      row_number() OVER {part()} AS rn FROM x) WHERE d <> d0 AND rn >= 168), tg AS (SELECT *, {columns(_HIST)} FROM x WINDOW
      h AS (PARTITION BY point, hour ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      w AS (PARTITION BY point, isodow(d), hour ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT tg.*, snap.* EXCLUDE (point, d, d0), CASE WHEN spread <= -20 THEN 0 WHEN spread <= -5 THEN 1 WHEN spread <= 5 THEN 2 WHEN spread <= 20 THEN 3 ELSE 4 END AS target_class,
      hour BETWEEN 6 AND 10 OR hour BETWEEN 17 AND 21 AS target_is_peak, dam_price - dam_mean_7d AS dam_vs_7d_mean,
      len(list_filter(dams, lambda v: v < dam_price)) / CAST(len(dams) AS DOUBLE) AS dam_percentile_7d, dam_price - coalesce(rtm_same_hour_hist, rtm_mean_7d) AS dam_vs_same_hour,
      CASE WHEN dam_price <= 0 THEN NULL WHEN dam_price <= 20 THEN 0 WHEN dam_price <= 40 THEN 1 WHEN dam_price <= 60 THEN 2 WHEN dam_price <= 100 THEN 3
      WHEN dam_price <= 200 THEN 4 ELSE 5 END AS dam_price_level FROM tg JOIN snap ON snap.point = tg.point AND snap.d = tg.d""",
)
def delta_samples(spark, d):
    return delta.samples(hourly(spark, d), ["point"])


PX = """SELECT point, CAST(t AS DATE) AS d, hour(t) + 1 AS h, price * 0.7071067811865476 AS price FROM b_rtm1h UNION ALL SELECT 'HUB', CAST(t AS DATE), hour(t) + 1, hub * 0.7071067811865476 FROM b_hub1h"""
_DINT = [
    "hour", "day_of_week", "day_of_month", "month", "quarter", "week_of_year", "is_weekend", "is_holiday", "is_peak_hour", "is_summer",
    "dam_d1_spike_count", "dam_7d_spike_count", "dam_d1_had_spike", "dam_lag_24h_is_spike", "dam_d1_max_hour",
]
_DNUM = [c for c in daily.FEATURES if c not in _DINT]


@query(
    "dam_daily_features", text="point", dates="d", ints=" ".join(_DINT), nums=" ".join(_DNUM) + " target",
    sql=f"""WITH x AS ({PX}), days AS (SELECT point, d, row_number() OVER (PARTITION BY point ORDER BY d) AS i FROM (SELECT DISTINCT point, d FROM x)),
      px AS (SELECT x.*, i FROM x JOIN days USING (point, d)), ds AS (SELECT point, i, count(*) AS n, avg(price) AS mean, max(price) AS mx, min(price) AS mn, stddev_pop(price) AS sd,
      count(*) FILTER (price > 25) AS sc, min(h) FILTER (price = m) AS am FROM (SELECT *, max(price) OVER (PARTITION BY point, i) AS m FROM px) GROUP BY 1, 2),
      wk AS (SELECT a.point, a.i, avg(p.price) AS mean, stddev_pop(p.price) AS sd, count(*) FILTER (p.price > 25) AS sc FROM days a JOIN px p ON p.point = a.point
      AND p.i BETWEEN a.i - 7 AND a.i - 1 GROUP BY 1, 2), sh AS (SELECT a.point, a.i, p.h, avg(p.price) AS mean, stddev_pop(p.price) AS sd, count(*) AS n FROM days a JOIN px p
      ON p.point = a.point AND p.i BETWEEN a.i - 7 AND a.i - 1 GROUP BY 1, 2, 3), fw AS (SELECT a.point, a.i, p.h, avg(p.price) AS mean FROM days a JOIN px p ON p.point = a.point
      AND p.i IN (a.i - 7, a.i - 14, a.i - 21, a.i - 28) GROUP BY 1, 2, 3)
      SELECT t.point, t.d, t.price AS target, t.h AS hour, isodow(t.d) - 1 AS day_of_week, day(t.d) AS day_of_month, month(t.d) AS month, quarter(t.d) AS quarter,
      weekofyear(t.d) AS week_of_year, isodow(t.d) >= 6 AS is_weekend, {MAJOR.replace("(d)", "(t.d)")} AS is_holiday, t.h BETWEEN 7 AND 22 AS is_peak_hour,
      month(t.d) BETWEEN 6 AND 9 AS is_summer, l1.price AS dam_lag_24h, lp.price AS dam_lag_24h_prev, ln.price AS dam_lag_24h_next, l2.price AS dam_lag_48h, l7.price AS dam_lag_168h,
      d1.mean AS dam_d1_mean, d1.mx AS dam_d1_max, d1.mn AS dam_d1_min, d1.sd AS dam_d1_std, wk.mean AS dam_7d_mean, coalesce(sh.mean, l1.price) AS dam_7d_same_hour_mean,
      coalesce(fw.mean, l7.price) AS dam_4w_same_dow_hour_mean, l1.price / (d1.mean + 1e-6) AS dam_d1_hour_ratio, coalesce(sh.mean, l1.price) / (wk.mean + 1e-6) AS dam_7d_hour_ratio,
      d1.mean - d2.mean AS dam_d1_vs_d2, d1.mean - d7.mean AS dam_d1_vs_d7, (d1.mean - d3.mean) / 3 AS dam_trend_3d, wk.sd / (wk.mean + 1e-6) AS dam_7d_cv,
      d1.mx - d1.mn AS dam_d1_range, CASE WHEN sh.n > 1 THEN sh.sd ELSE 0 END AS dam_7d_same_hour_std, d1.sc AS dam_d1_spike_count, wk.sc AS dam_7d_spike_count,
      d1.sc > 0 AS dam_d1_had_spike, l1.price > 25 AS dam_lag_24h_is_spike, d1.am AS dam_d1_max_hour
      FROM px t JOIN ds d1 ON d1.point = t.point AND d1.i = t.i - 1 AND d1.n = 24 JOIN ds d7 ON d7.point = t.point AND d7.i = t.i - 7 AND d7.n = 24
      JOIN ds d2 ON d2.point = t.point AND d2.i = t.i - 2 JOIN ds d3 ON d3.point = t.point AND d3.i = t.i - 3 JOIN wk ON wk.point = t.point AND wk.i = t.i
      JOIN px l1 ON l1.point = t.point AND l1.i = t.i - 1 AND l1.h = t.h JOIN px lp ON lp.point = t.point AND lp.i = t.i - 1 AND lp.h = greatest(t.h - 1, 1)
      JOIN px ln ON ln.point = t.point AND ln.i = t.i - 1 AND ln.h = least(t.h + 1, 24) LEFT JOIN px l2 ON l2.point = t.point AND l2.i = t.i - 2 AND l2.h = t.h
      JOIN px l7 ON l7.point = t.point AND l7.i = t.i - 7 AND l7.h = t.h LEFT JOIN sh ON sh.point = t.point AND sh.i = t.i AND sh.h = t.h
      LEFT JOIN fw ON fw.point = t.point AND fw.i = t.i AND fw.h = t.h WHERE t.i > 8""",
)
def dam_daily_features(spark, d):
    r = base.b_rtm1h(spark, d).select("point", "t", (F.col("price") * UNIT).alias("price"))
    hub = base.b_hub1h(spark, d).select(F.lit("HUB").alias("point"), "t", (F.col("hub") * UNIT).alias("price"))
    x = r.unionByName(hub).select("point", F.col("t").cast("date").alias("d"), (F.hour("t") + 1).alias("h"), "price")
    return daily.daily_features(x, ["point"], "d", "h", "price", min_history=8, spike=25.0)


# --- wind and load ----------------------------------------------------------------------------------------------

G3 = "SELECT 'all' AS point, t, gen * 0.7071067811865476 AS gen FROM b_gen"


def _lag_roll_sql(prefix, lags, windows, changes, floor):
    c = "gen"
    out = {f"{prefix}_lag_{n}h": lag(c, n) for n in lags}
    out |= {f"{prefix}_roll_{n}h_{s}": roll(SQLF[s], c, n, 1, 1) for n in windows for s in ("mean", "std", "min", "max")}
    for n in changes:
        ch = f"({lag(c, 1)} - {lag(c, 1 + n)})"
        out |= {f"{prefix}_change_{n}h": ch, f"{prefix}_roc_{n}h": f"CASE WHEN {lag(c, 1 + n)} IS NOT NULL THEN {ch} / greatest({lag(c, 1 + n)}, {floor}) END"}
    return out


_WL = _lag_roll_sql("wind_gen", [1, 2, 3, 6, 12, 24], [6, 12, 24], [1, 3, 6], 100)
_LL = _lag_roll_sql("load", [1, 2, 3, 6, 12, 24, 48, 168], [6, 12, 24, 168], [1, 24], 1000)


def _g3(spark, d):
    return base.b_gen(spark, d).select(F.lit("all").alias("point"), "t", (F.col("gen") * UNIT).alias("gen"))


@query(
    "wind_lag_roll", times="t", nums=" ".join(_WL), ints="ramp_down_1h ramp_down_3h ramp_up_1h",
    sql=f"""SELECT *, coalesce(wind_gen_change_1h < -1000, false) AS ramp_down_1h, coalesce(wind_gen_change_3h < -2000, false) AS ramp_down_3h,
      coalesce(wind_gen_change_1h > 1000, false) AS ramp_up_1h FROM (SELECT t, {columns(_WL)} FROM ({G3}))""",
)
def wind_lag_roll(spark, d):
    build = lambda g, w: generation.lag_roll(g, ["point"], "gen", "wind_gen", [1, 2, 3, 6, 12, 24], [6, 12, 24], [1, 3, 6], 100, w)
    w = in_blocks(_g3(spark, d), ["point"], "t", build, 24)
    return generation.ramp_flags(w, "wind_gen")


@query("load_lag_roll", times="t", nums=" ".join(_LL), sql=f"SELECT t, {columns(_LL)} FROM ({G3})")
def load_lag_roll(spark, d):
    build = lambda g, w: generation.lag_roll(g, ["point"], "gen", "load", [1, 2, 3, 6, 12, 24, 48, 168], [6, 12, 24, 168], [1, 24], 1000, w)
    return in_blocks(_g3(spark, d), ["point"], "t", build, 168)
