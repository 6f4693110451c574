"""Projections, filters, predicates and scalar rules."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import calendar as cal
from ..functions import rules
from ..functions.frames import series
from ..operators import fill
from . import base
from ..operators.ranked import in_blocks
from .registry import query


def loc(u: str) -> str:
    return f"(({u}) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago')"


RANGE_START, RANGE_END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"
RANGE_POINTS = ["click", "view"]


@query(
    "filter_points_range", text="market point", times="t", nums="price",
    sql=f"""SELECT 'rtm' AS market, point, t, price FROM b_rtm15 WHERE point IN ('click', 'view')
      AND t > TIMESTAMP '{RANGE_START}' AND t <= TIMESTAMP '{RANGE_END}'
      UNION ALL SELECT 'dam', point, t, price FROM b_rtm1h WHERE point IN ('click', 'view')
      AND t >= TIMESTAMP '{RANGE_START}' AND t < TIMESTAMP '{RANGE_END}'""",
)
def filter_points_range(spark, d):
    rt = base.b_rtm15(spark, d).filter(
        F.col("point").isin(RANGE_POINTS) & (F.col("t") > RANGE_START) & (F.col("t") <= RANGE_END)
    )
    da = base.b_rtm1h(spark, d).filter(
        F.col("point").isin(RANGE_POINTS) & (F.col("t") >= RANGE_START) & (F.col("t") < RANGE_END)
    )
    return rt.withColumn("market", F.lit("rtm")).unionByName(da.withColumn("market", F.lit("dam")))


def _days(spark, d):
    return base.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders"


@query(
    "local_day_bounds", dates="d", times="start_utc end_utc", ints="hours",
    sql=f"""SELECT d, s AS start_utc, e AS end_utc, date_diff('hour', s, e) AS hours FROM (
      SELECT d, (CAST(d AS TIMESTAMP) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC' AS s,
      (CAST(d + 1 AS TIMESTAMP) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC' AS e FROM ({DAYS}))""",
)
def local_day_bounds(spark, d):
    start, end = cal.local_day_bounds(F.col("d"))
    days = _days(spark, d).select("d", start.alias("start_utc"), end.alias("end_utc"))
    return days.withColumn("hours", (F.unix_timestamp("end_utc") - F.unix_timestamp("start_utc")) / 3600)


@query(
    "fixed_offset_day_bounds", dates="d", times="start_utc end_utc",
    sql=f"""SELECT d, CAST(d AS TIMESTAMP) + INTERVAL 6 HOUR AS start_utc, CAST(d AS TIMESTAMP) + INTERVAL 30 HOUR AS end_utc
      FROM ({DAYS})""",
)
def fixed_offset_day_bounds(spark, d):
    start, end = cal.fixed_day_bounds(F.col("d"))
    return _days(spark, d).select("d", start.alias("start_utc"), end.alias("end_utc"))


def _hours(spark, d):
    """Every hour of every order date, with a varying quarter."""
    h = _days(spark, d).select("d", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    return h.withColumn("u", F.timestamp_seconds(F.unix_timestamp(F.col("d").cast("timestamp")) + F.col("h") * 3600 + (F.col("h") % 4) * 900))


HOURS = f"SELECT d, h, CAST(d AS TIMESTAMP) + to_hours(h) + to_minutes(h % 4 * 15) AS u FROM ({DAYS}), range(24) AS r(h)"


@query(
    "utc_to_market_parts", times="u", dates="delivery_date", ints="delivery_hour delivery_interval repeated_hour",
    sql=f"""SELECT u, CASE WHEN hour(l) = 0 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS delivery_date,
      CASE WHEN hour(l) = 0 THEN 24 ELSE hour(l) END AS delivery_hour, minute(l) // 15 + 1 AS delivery_interval,
      (l = {loc("u - INTERVAL 1 HOUR")}) AS repeated_hour FROM (SELECT u, {loc("u")} AS l FROM ({HOURS}))""",
)
def utc_to_market_parts(spark, d):
    return cal.utc_to_market_parts(_hours(spark, d), "u")


LOCAL_CASES = f"""SELECT l, l + INTERVAL 6 HOUR AS u0, l + INTERVAL 5 HOUR AS u1,
   {loc("l + INTERVAL 6 HOUR")} = l AS v0, {loc("l + INTERVAL 5 HOUR")} = l AS v1, d, h FROM """


@query(
    "market_parts_to_utc", dates="d", ints="delivery_hour delivery_interval", times="utc",
    sql=f"""SELECT d, h + 1 AS delivery_hour, h % 4 + 1 AS delivery_interval, CASE WHEN v0 AND v1 THEN NULL WHEN v0 THEN u0
      WHEN v1 THEN u1 ELSE date_trunc('hour', u0) END AS utc FROM ({LOCAL_CASES} (SELECT u AS l, d, h FROM ({HOURS})))""",
)
def market_parts_to_utc(spark, d):
    parts = _days(spark, d).select("d", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("delivery_hour"))
    parts = parts.withColumn("delivery_interval", (F.col("delivery_hour") - 1) % 4 + 1)
    return parts.withColumn("utc", cal.market_parts_to_utc(F.col("d"), F.col("delivery_hour"), F.col("delivery_interval")))


@query(
    "market_hour_start", dates="d", ints="hour_ending", times="dt",
    sql=f"""SELECT d, he AS hour_ending, CASE WHEN v1 THEN u1 WHEN v0 THEN u0 END - INTERVAL 1 HOUR AS dt FROM (
      {LOCAL_CASES.replace(", h FROM", ", he FROM")} (SELECT d, he, CAST(d AS TIMESTAMP) + to_hours(he % 24) AS l
      FROM ({DAYS}), range(1, 25) AS r(he))) WHERE v0 OR v1""",
)
def market_hour_start(spark, d):
    return cal.market_hour_grid(_days(spark, d), "d")


@query(
    "clean_market_keys", text="settlement_point", dates="delivery_date", ints="o_orderkey delivery_hour repeated_hour known_point",
    sql="""SELECT o_orderkey, upper(o_orderpriority) AS settlement_point, CAST(o_orderdate AS DATE) AS delivery_date,
      o_custkey % 24 + 1 AS delivery_hour, CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS repeated_hour,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END AS known_point FROM orders""",
)
def clean_market_keys(spark, d):
    h = (F.col("o_custkey") % 24 + 1).cast("string")
    status = F.col("o_orderstatus")
    raw = base.read(spark, d, "orders").select(
        "o_orderkey",
        F.when(status == "F", F.concat(F.lpad(h, 2, "0"), F.lit(":00"))).when(status == "O", F.concat(h, F.lit(":00"))).otherwise(h).alias("hour"),
        F.when(status == "F", "Y").when(status == "O", "True").otherwise("N").alias("repeated"),
        F.when(status == "F", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")).alias("point"),
    )
    return rules.clean_market_keys(raw, ["1-URGENT", "2-HIGH", "3-MEDIUM"])


MAJOR = """((month(d), day(d)) IN ((1, 1), (7, 4), (11, 11), (12, 25), (12, 31))
   OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28) OR (month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7)
   OR (month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25))"""


@query("holiday_flag_major", dates="d", ints="is_holiday", sql=f"SELECT d, {MAJOR} AS is_holiday FROM ({DAYS})")
def holiday_flag_major(spark, d):
    return _days(spark, d).withColumn("is_holiday", cal.major_holiday(F.col("d")))


def _observed(m, day):
    return (
        f"((month(d) = {m} AND day(d) = {day} AND isodow(d) <= 5)"
        f" OR (isodow(d) = 5 AND month(d + 1) = {m} AND day(d + 1) = {day})"
        f" OR (isodow(d) = 1 AND month(d - 1) = {m} AND day(d - 1) = {day}))"
    )


FEDERAL = " OR ".join(
    [_observed(*x) for x in ((1, 1), (7, 4), (11, 11), (12, 25))]
    + [
        "(month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21)",
        "(month(d) = 2 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21)",
        "(month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25)",
        "(month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7)",
        "(month(d) = 10 AND isodow(d) = 1 AND day(d) BETWEEN 8 AND 14)",
        "(month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28)",
        f"(year(d) >= 2021 AND {_observed(6, 19)})",
    ]
)


@query("holiday_flag_federal", dates="d", ints="is_holiday", sql=f"SELECT d, ({FEDERAL}) AS is_holiday FROM ({DAYS})")
def holiday_flag_federal(spark, d):
    days = _days(spark, d)
    holidays = cal.federal_holidays(days.select(F.year("d").alias("y")).distinct())
    hit = days.join(holidays, days.d == holidays.holiday, "left")
    return hit.withColumn("is_holiday", F.col("holiday").isNotNull())


@query(
    "calendar_features", times="t",
    ints="hour minute day_of_week day_of_month month quarter week_of_year is_weekend is_peak_hour is_summer is_super_peak"
    " is_holiday is_business_day hour_block hour_dow_interaction is_morning_ramp is_evening_ramp",
    sql=f"""SELECT t, h AS hour, minute(t) AS minute, dow AS day_of_week, day(t) AS day_of_month, m AS month,
      quarter(t) AS quarter, weekofyear(t) AS week_of_year, we AS is_weekend, h BETWEEN 7 AND 22 AS is_peak_hour,
      su AS is_summer, su AND h BETWEEN 14 AND 20 AND NOT we AS is_super_peak, hol AS is_holiday,
      NOT we AND NOT hol AS is_business_day, CASE WHEN h <= 6 THEN 0 WHEN h <= 12 THEN 1 WHEN h <= 18 THEN 2 ELSE 3 END
      AS hour_block, h * 10 + dow AS hour_dow_interaction, h BETWEEN 5 AND 9 AND NOT we AND NOT hol AS is_morning_ramp,
      h BETWEEN 17 AND 20 AND su AS is_evening_ramp FROM (SELECT t, hour(t) AS h, isodow(t) - 1 AS dow, month(t) AS m,
      isodow(t) >= 6 AS we, month(t) BETWEEN 6 AND 9 AS su, {MAJOR} AS hol FROM (SELECT t, CAST(t AS DATE) AS d FROM b_when))""",
)
def calendar_features(spark, d):
    return cal.calendar_features(base.b_when(spark, d), "t")


_CYC = {"hour": ("hour", 24), "dow": ("isodow", 7), "month": ("month", 12), "doy": ("dayofyear", 365.25), "minute": ("minute", 60)}


@query(
    "cyclic_encoding", times="t", nums=" ".join(f"{n}_sin {n}_cos" for n in _CYC),
    sql="SELECT t, " + ", ".join(
        f"{f}(({fn}(t){' - 1' if fn == 'isodow' else ''}) * {2 * math.pi!r} / {p}) AS {n}_{f}"
        for n, (fn, p) in _CYC.items() for f in ("sin", "cos")) + " FROM b_when",
)
def cyclic_encoding(spark, d):
    t = F.col("t")
    parts = {"hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t), "doy": F.dayofyear(t), "minute": F.minute(t)}
    out = base.b_when(spark, d)
    for n, (_, period) in _CYC.items():
        s, c = cal.cyclic(parts[n], period)
        out = out.withColumns({f"{n}_sin": s, f"{n}_cos": c})
    return out


_SEASON = """month(t) IN (12, 1, 2) AS is_winter, month(t) IN (3, 4, 5) AS is_spring, month(t) IN (6, 7, 8) AS is_summer,
   month(t) IN (9, 10, 11) AS is_fall"""


@query(
    "season_flags", text="variant", times="t",
    ints="is_winter is_spring is_summer is_fall is_morning is_afternoon is_evening is_night",
    sql=" UNION ALL ".join(
        f"""SELECT '{v}' AS variant, t, {_SEASON}, hour(t) >= {a} AND hour(t) < {b} AS is_morning,
        hour(t) >= {b} AND hour(t) < {c} AS is_afternoon, hour(t) >= {c} AND hour(t) < {e} AS is_evening,
        hour(t) >= {e} OR hour(t) < {a} AS is_night FROM b_when"""
        for v, (a, b, c, e) in {"wind": (5, 12, 17, 22), "helper": (6, 12, 18, 22)}.items()),
)
def season_flags(spark, d):
    t = base.b_when(spark, d)
    wind = cal.season_flags(t, "t", (5, 12, 17, 22)).withColumn("variant", F.lit("wind"))
    helper = cal.season_flags(t, "t", (6, 12, 18, 22)).withColumn("variant", F.lit("helper"))
    return wind.unionByName(helper)


@query(
    "no_solar_flags", times="t", ints="is_no_solar_period is_evening_peak hours_to_sunset hours_since_sunset",
    sql="""SELECT t, h >= 19 OR h < 7 AS is_no_solar_period, h >= 17 AND h < 21 AS is_evening_peak,
      least(greatest(19 - h, -12), 12) AS hours_to_sunset, CASE WHEN h >= 19 THEN h - 19 WHEN h < 7 THEN h + 5 ELSE 0 END
      AS hours_since_sunset FROM (SELECT t, hour(t) AS h FROM b_when)""",
)
def no_solar_flags(spark, d):
    return rules.no_solar_flags(base.b_when(spark, d), "t")


@query(
    "sunrise_minutes", times="t", nums="minutes_to_sunrise", ints="is_pre_sunrise is_post_sunrise is_evening_peak",
    sql="""SELECT t, m AS minutes_to_sunrise, m > 0 AND m < 120 AS is_pre_sunrise, m < 0 AND m > -120 AS is_post_sunrise,
      hour(t) BETWEEN 17 AND 22 AS is_evening_peak FROM (SELECT t, CASE WHEN r < -720 THEN r + 1440 ELSE r END AS m FROM (
      SELECT t, (12 - degrees(acos(-tan(radians(29.76)) * tan(radians(decl)))) / 15.0 - (hour(t) + minute(t) / 60.0)) * 60 AS r
      FROM (SELECT t, 23.45 * sin(radians((dayofyear(t) - 81) * (CAST(360 AS DOUBLE) / 365))) AS decl FROM b_when)))""",
)
def sunrise_minutes(spark, d):
    return cal.sunrise_features(base.b_when(spark, d), "t")


@query(
    "spread_class", text="point", times="t", nums="spread", ints="spread_class",
    sql="""SELECT point, t, actual - pred AS spread, CASE WHEN actual - pred <= -20 THEN 0 WHEN actual - pred <= -5 THEN 1
      WHEN actual - pred <= 5 THEN 2 WHEN actual - pred <= 20 THEN 3 ELSE 4 END AS spread_class FROM b_err""",
)
def spread_class(spark, d):
    e = base.b_err(spark, d).withColumn("spread", F.col("actual") - F.col("pred"))
    return e.withColumn("spread_class", rules.spread_class(F.col("spread")))


@query(
    "price_level_bin", ints="event_id level", nums="x",
    sql="""SELECT event_id, price - 10 AS x, CASE WHEN price - 10 <= 0 THEN NULL WHEN price - 10 <= 20 THEN 0
      WHEN price - 10 <= 40 THEN 1 WHEN price - 10 <= 60 THEN 2 WHEN price - 10 <= 100 THEN 3 WHEN price - 10 <= 200 THEN 4
      ELSE 5 END AS level FROM b_ev""",
)
def price_level_bin(spark, d):
    return base.b_ev(spark, d).withColumn("x", F.col("price") - 10).withColumn("level", rules.price_level_bin(F.col("x")))


def case_map(col, mapping):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    "fuel_group_map", text="fuel coarse expanded", ints="n", nums="mw",
    sql=f"""SELECT fuel, {case_map("fuel", rules.FUEL_GROUPS)} AS coarse, {case_map("fuel", rules.FUEL_GROUPS_EXPANDED)} AS expanded,
      count(*) AS n, sum(mw) AS mw FROM b_fuel GROUP BY ALL""",
)
def fuel_group_map(spark, d):
    f = base.b_fuel(spark, d).withColumns(
        {"coarse": rules.mapped(F.col("fuel"), rules.FUEL_GROUPS), "expanded": rules.mapped(F.col("fuel"), rules.FUEL_GROUPS_EXPANDED)}
    )
    return f.groupBy("fuel", "coarse", "expanded").agg(F.count("*").alias("n"), F.sum("mw").alias("mw"))


@query(
    "risk_level", ints="doc_id alert", text="risk", nums="prob",
    sql="""SELECT doc_id, prob, CASE WHEN prob >= 0.8 THEN 'critical' WHEN prob >= 0.6 THEN 'high' WHEN prob >= 0.3
      THEN 'medium' ELSE 'low' END AS risk, prob >= 0.3 AS alert FROM (SELECT doc_id, least(greatest(p * 1.5 - 0.2, 0), 1) AS prob
      FROM b_score)""",
)
def risk_level(spark, d):
    s = base.b_score(spark, d).withColumn("prob", rules.clamp(F.col("p") * 1.5 - 0.2, 0.0, 1.0))
    return s.withColumns({"risk": rules.risk_level(F.col("prob")), "alert": F.col("prob") >= 0.3})


@query(
    "trading_signal", text="point signal", times="t", nums="spread",
    sql="""SELECT point, t, s AS spread, CASE WHEN abs(s) > 15 AND p > 0.6 THEN 'STRONG_' || side WHEN abs(s) > 5 THEN side
      ELSE 'HOLD' END AS signal FROM (SELECT point, t, pred - actual AS s, pred / 100 AS p,
      CASE WHEN pred - actual > 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM b_err)""",
)
def trading_signal(spark, d):
    e = base.b_err(spark, d).withColumn("spread", F.col("pred") - F.col("actual"))
    return e.withColumn("signal", rules.trading_signal(F.col("spread"), F.col("pred") / 100))


def wind_cells(spark, d):
    """Events read as cells of a gridded weather field."""
    k, p = F.col("k"), F.col("price")
    return base.b_ev(spark, d).select(
        "event_id", F.col("point").alias("region"), cal.floor_time(F.col("ts"), 60).alias("t"),
        ((k - 50) / 8).alias("u10"), ((p - 50) / 20).alias("v10"), ((k - 50) / 4).alias("u80"), ((p - 50) / 10).alias("v80"),
        (p * 10 + 99000).alias("sp"), (k / 5 + 270).alias("tk"),
    )


WIND_CELLS = """SELECT event_id, point AS region, date_trunc('hour', ts) AS t, (k - 50) / 8 AS u10, (price - 50) / 20 AS v10,
   (k - 50) / 4 AS u80, (price - 50) / 10 AS v80, price * 10 + 99000 AS sp, k / 5 + 270 AS tk FROM b_ev"""
WIND_PHYSICS = f"""SELECT event_id, region, t, ws10 AS ws_10m, ws80 AS ws_80m,
   (270 - degrees(atan2(v80, u80))) - 360 * floor((270 - degrees(atan2(v80, u80))) / 360) AS wind_dir,
   CASE WHEN ws80 < 3 THEN 0 WHEN ws80 < 12 THEN pow((ws80 - 3) / 9, 3) WHEN ws80 <= 25 THEN 1 ELSE 0 END AS normalized_power,
   CASE WHEN ws80 BETWEEN 3 AND 12 THEN pow((ws80 - 3) / 9, 2) ELSE 0 END AS power_sensitivity,
   sp / (tk * 287.05) AS air_density, 0.5 * (sp / (tk * 287.05)) * pow(ws80, 3) AS power_density,
   least(greatest(coalesce(CASE WHEN ws10 > 0 AND ws80 > 0 THEN ln(ws80 / ws10) / ln(CAST(8 AS DOUBLE)) END, 0.143), 0), 0.5) AS wind_shear
   FROM (SELECT *, sqrt(u10 * u10 + v10 * v10) AS ws10, sqrt(u80 * u80 + v80 * v80) AS ws80 FROM ({WIND_CELLS}))"""


@query(
    "wind_physics_features", ints="event_id",
    nums="ws_10m ws_80m wind_dir normalized_power power_sensitivity air_density power_density wind_shear",
    sql=WIND_PHYSICS,
)
def wind_physics_features(spark, d):
    return rules.wind_physics_features(wind_cells(spark, d), "u10", "v10", "u80", "v80", "sp", "tk")


@query(
    "inverse_power_proxy", times="t", nums="normalized_power_mean ws_80m_mean ws_80m_std power_sensitivity",
    sql="""SELECT t, n AS normalized_power_mean, ws AS ws_80m_mean, ws * 0.15 AS ws_80m_std, CASE WHEN ws BETWEEN 3 AND 12
      THEN 3 * pow((ws - 3) / 9, 2) / 9 ELSE 0 END AS power_sensitivity FROM (SELECT t, n,
      3.0 + 9.0 * pow(least(greatest(n, 0.001), 0.999), CAST(1 AS DOUBLE) / 3) AS ws FROM (SELECT t, gen / 39000 AS n FROM b_gen))""",
)
def inverse_power_proxy(spark, d):
    return rules.inverse_power_proxy(base.b_gen(spark, d), "gen", capacity=39000.0)


@query(
    "wind_chill_features", text="station", times="t", nums="chill_metric chill_imperial chill_f",
    sql="""SELECT station, t, CASE WHEN x < 10 AND wind > 4.8 THEN 13.12 + 0.6215 * x - 11.37 * pow(greatest(wind, 4.8), 0.16)
      + 0.3965 * x * pow(greatest(wind, 4.8), 0.16) ELSE x END AS chill_metric,
      CASE WHEN x < 10 AND wind > 4.8 THEN (35.74 + 0.6215 * (x * 9 / 5 + 32) - 35.75 * pow(wind * 0.621371, 0.16)
      + 0.4275 * (x * 9 / 5 + 32) * pow(wind * 0.621371, 0.16) - 32) * 5 / 9 ELSE x END AS chill_imperial,
      CASE WHEN x * 9 / 5 + 32 > 50 OR wind < 3 THEN x * 9 / 5 + 32 ELSE 35.74 + 0.6215 * (x * 9 / 5 + 32) - 35.75 * pow(wind, 0.16)
      + 0.4275 * (x * 9 / 5 + 32) * pow(wind, 0.16) END AS chill_f FROM (SELECT *, temp - 10 AS x FROM b_wx)""",
)
def wind_chill_features(spark, d):
    w, t, v = base.b_wx(spark, d), F.col("temp") - 10, F.col("wind")
    return w.withColumns(
        {
            "chill_metric": rules.wind_chill_metric(t, v),
            "chill_imperial": rules.wind_chill_imperial_in_celsius(t, v),
            "chill_f": rules.wind_chill_fahrenheit(t * 9 / 5 + 32, v),
        }
    )


@query(
    "frontal_score", text="station", times="t", nums="front",
    sql="""SELECT station, t, least((CASE WHEN dt < -2 THEN 0.3 WHEN dt < -1 THEN 0.15 ELSE 0 END)
      + (CASE WHEN abs(dd) > 45 THEN 0.3 WHEN abs(dd) > 20 THEN 0.15 ELSE 0 END)
      + (CASE WHEN dp > 100 THEN 0.3 WHEN dp > 50 THEN 0.15 ELSE 0 END)
      + (CASE WHEN dt < -1 AND abs(dd) > 30 AND dp > 50 THEN 0.1 ELSE 0 END), 1) AS front FROM (
      SELECT station, t, temp - lag(temp) OVER w AS dt, (wdir - lag(wdir) OVER w + 180) - 360 * floor((wdir - lag(wdir) OVER w + 180) / 360)
      - 180 AS dd, (pressure - lag(pressure) OVER w) * 100 AS dp FROM b_wx WINDOW w AS (PARTITION BY station ORDER BY t))""",
)
def frontal_score(spark, d):
    w = series("station")
    x = base.b_wx(spark, d)
    dt = F.col("temp") - F.lag("temp").over(w)
    dd = rules.wrap_degrees(F.col("wdir") - F.lag("wdir").over(w))
    dp = (F.col("pressure") - F.lag("pressure").over(w)) * 100
    x = x.withColumns({"dt": dt, "dd": dd, "dp": dp})
    return x.withColumn("front", rules.frontal_score(F.col("dt"), F.col("dd"), F.col("dp")))


@query(
    "ramp_down_risk", times="t", nums="change risk",
    sql="""SELECT t, c AS change, least((CASE WHEN c < -1000 THEN 0.15 ELSE 0 END) + (CASE WHEN c < -2000 THEN 0.20 ELSE 0 END)
      + (CASE WHEN c < -3000 THEN 0.20 ELSE 0 END) + (CASE WHEN c < -5000 THEN 0.15 ELSE 0 END)
      + (CASE WHEN hour(t) >= 19 OR hour(t) < 7 THEN 0.15 ELSE 0 END)
      + (CASE WHEN hour(t) BETWEEN 19 AND 21 THEN 0.15 ELSE 0 END), 1) AS risk
      FROM (SELECT t, gen - lag(gen) OVER (ORDER BY t) AS c FROM b_gen)""",
)
def ramp_down_risk(spark, d):
    g = base.b_gen(spark, d).withColumn("sys", F.lit("all"))
    g = in_blocks(g, ["sys"], "t", lambda b, w: b.withColumn("change", F.col("gen") - F.lag("gen").over(w)), 1)
    h = F.hour("t")
    return g.withColumn("risk", rules.ramp_down_risk(F.col("change"), h, (h >= 19) | (h < 7)))


@query(
    "nullable_fill", times="t", nums="prc adder_filled adder_zero",
    sql="""SELECT t, prc, coalesce(last_value(adder IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      AS adder_filled, coalesce(adder, 0) AS adder_zero FROM b_res WHERE prc IS NOT NULL""",
)
def nullable_fill(spark, d):
    r = base.b_res(spark, d).withColumns({"sys": F.lit("all"), "adder_zero": F.col("adder"), "adder_filled": F.col("adder")})
    return fill.fill_nullable(r, ["sys"], "t", forward=["adder_filled"], zero=["adder_filled", "adder_zero"], required=["prc"])


@query(
    "narrow_types", text="delivery_date point", times="t", ints="peak", nums="price",
    sql="SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS delivery_date, point, t, hour(t) >= 7 AS peak, CAST(price AS FLOAT) AS price FROM b_rtm1h",
)
def narrow_types(spark, d):
    r = base.b_rtm1h(spark, d).withColumns({"delivery_date": F.col("t").cast("date"), "peak": (F.hour("t") >= 7).cast("int")})
    return rules.narrow_types(r, dates=["delivery_date"], flags=["peak"], measures=["price"])


def boxes(spark, d):
    r = F.col("r_regionkey")
    return base.read(spark, d, "region").select(
        F.col("r_name").alias("region"), (r * 2.0 + 25).alias("lat_min"), (r * 2.0 + 29).alias("lat_max"),
        (r * 1.5 - 107).alias("lon_min"), (r * 1.5 - 102).alias("lon_max"), ((r + 1) / 15).alias("weight"),
    )


@query(
    "region_box_assign", ints="c_custkey", text="region", nums="weight",
    sql="""WITH p AS (SELECT c_custkey, 24 + c_nationkey * 0.5 AS lat, 252 + c_custkey % 100 * 0.125 - 360 AS lon FROM customer),
      b AS (SELECT r_name AS region, r_regionkey * 2.0 + 25 AS a0, r_regionkey * 2.0 + 29 AS a1, r_regionkey * 1.5 - 107 AS o0,
      r_regionkey * 1.5 - 102 AS o1, (r_regionkey + 1) / CAST(15 AS DOUBLE) AS weight FROM region),
      x AS (SELECT * FROM b UNION ALL SELECT 'all', min(a0), max(a1), min(o0), max(o1), 1 FROM b)
      SELECT c_custkey, region, weight FROM p JOIN x ON lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1""",
)
def region_box_assign(spark, d):
    pts = base.read(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") * 0.5 + 24).alias("lat"), (F.col("c_custkey") % 100 * 0.125 + 252).alias("lon")
    )
    return rules.region_assign(pts, boxes(spark, d), "lat", "lon")
