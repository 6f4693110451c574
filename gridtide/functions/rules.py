"""Scalar rules as column expressions: bins, signals, risk, physics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fill import with_one_row
from .frames import clamp, flag

# Raw fuel name -> coarse group, and -> expanded group.
FUEL_GROUPS = {
    "Wind": "wind", "Wnd": "wind", "WSL": "wind", "Solar": "solar", "Sun": "solar",
    "Gas": "gas", "Gas-CC": "gas", "Gas_CC": "gas", "Gas_GT": "gas",
    "Nuclear": "nuclear", "Coal": "coal", "Hydro": "hydro",
}
FUEL_GROUPS_EXPANDED = {
    "Wind": "wind", "Wnd": "wind", "WSL": "wind", "Solar": "solar", "Sun": "solar",
    "Gas": "gas", "Gas-CC": "gas_cc", "Gas_CC": "gas_cc", "Gas_GT": "gas",
    "Nuclear": "nuclear", "Coal": "coal", "Hydro": "hydro", "Biomass": "biomass",
    "Oth": "other", "Other": "other",
}
COARSE_GROUPS = ["wind", "solar", "gas", "nuclear", "coal", "hydro"]
EXPANDED_GROUPS = ["gas", "gas_cc", "coal", "nuclear", "solar", "wind", "hydro", "biomass"]
SPREAD_BREAKS = [-20, -5, 5, 20]
PRICE_BREAKS = [0, 20, 40, 60, 100, 200]


def mapped(name: Column, mapping: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), name)


def right_closed_bin(x: Column, breaks: list[float], open_below: bool) -> Column:
    """Bin number of right-closed intervals. ``open_below``: values under the first break are bin 0,
    otherwise they have no bin."""
    out = None
    start = 0 if open_below else 1
    edges = breaks if open_below else breaks[1:]
    for i, edge in enumerate(edges):
        cond = x <= edge
        out = F.when(cond, i) if out is None else out.when(cond, i)
    out = out.when(x.isNotNull(), len(edges))
    return out if start == 0 else F.when(x > breaks[0], out)


def spread_class(spread: Column) -> Column:
    return right_closed_bin(spread, SPREAD_BREAKS, open_below=True)


def price_level_bin(price: Column) -> Column:
    return right_closed_bin(price, PRICE_BREAKS, open_below=False)


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.8, "critical").when(p >= 0.6, "high").when(p >= 0.3, "medium").otherwise("low")


def trading_signal(spread: Column, p: Column) -> Column:
    side = F.when(spread > 0, "LONG").otherwise("SHORT")
    return (
        F.when((F.abs(spread) > 15) & (p > 0.6), F.concat(F.lit("STRONG_"), side))
        .when(F.abs(spread) > 5, side)
        .otherwise("HOLD")
    )


def no_solar_flags(df: DataFrame, ts: str) -> DataFrame:
    hour = F.hour(ts)
    dark = (hour >= 19) | (hour < 7)
    return df.withColumns(
        {
            "is_no_solar_period": dark.cast("int"),
            "is_evening_peak": ((hour >= 17) & (hour < 21)).cast("int"),
            "hours_to_sunset": clamp(19 - hour, -12, 12),
            "hours_since_sunset": F.when(hour >= 19, hour - 19).when(hour < 7, hour + 5).otherwise(0),
        }
    )


def wind_physics_features(df: DataFrame, u10: str, v10: str, u80: str, v80: str, pressure: str, temp: str) -> DataFrame:
    """Speed, direction, normalised power, sensitivity, density, power density and shear per grid point."""
    ws10 = F.sqrt(F.col(u10) ** 2 + F.col(v10) ** 2)
    ws80 = F.sqrt(F.col(u80) ** 2 + F.col(v80) ** 2)
    df = df.withColumns({"ws_10m": ws10, "ws_80m": ws80})
    ws10, ws80 = F.col("ws_10m"), F.col("ws_80m")
    power = (
        F.when(ws80 < 3, 0.0).when(ws80 < 12, ((ws80 - 3) / 9) ** 3).when(ws80 <= 25, 1.0).otherwise(0.0)
    )
    shear = F.when((ws10 > 0) & (ws80 > 0), F.log(F.try_divide(ws80, ws10)) / math.log(80 / 10))
    density = F.coalesce(F.try_divide(F.col(pressure), F.col(temp) * 287.05), F.lit(1.225))
    return df.withColumns(
        {
            "wind_dir": F.pmod(270 - F.degrees(F.atan2(F.col(v80), F.col(u80))), F.lit(360.0)),
            "normalized_power": power,
            "power_sensitivity": F.when((ws80 >= 3) & (ws80 <= 12), ((ws80 - 3) / 9) ** 2).otherwise(0.0),
            "air_density": density,
            "power_density": 0.5 * density * ws80**3,
            "wind_shear": clamp(F.coalesce(shear, F.lit(0.143)), 0.0, 0.5),
        }
    )


def inverse_power_proxy(df: DataFrame, gen: str, capacity: float = 40000.0) -> DataFrame:
    norm = F.col(gen) / capacity
    ws = 3.0 + 9.0 * F.pow(clamp(norm, 0.001, 0.999), F.lit(1.0 / 3.0))
    return df.withColumns(
        {
            "normalized_power_mean": norm,
            "ws_80m_mean": ws,
            "ws_80m_std": ws * 0.15,
            "power_sensitivity": F.when((ws >= 3) & (ws <= 12), 3 * ((ws - 3) / 9) ** 2 / 9).otherwise(0.0),
        }
    )


def wind_chill_metric(t: Column, v: Column) -> Column:
    """Celsius and km/h; the plain temperature where the formula does not apply."""
    vp = F.pow(F.greatest(v, F.lit(4.8)), F.lit(0.16))
    return F.when((t < 10) & (v > 4.8), 13.12 + 0.6215 * t - 11.37 * vp + 0.3965 * t * vp).otherwise(t)


def _imperial(t_f: Column, mph: Column) -> Column:
    vp = F.pow(mph, F.lit(0.16))
    return 35.74 + 0.6215 * t_f - 35.75 * vp + 0.4275 * t_f * vp


def wind_chill_imperial_in_celsius(t: Column, v: Column) -> Column:
    value = (_imperial(t * 9.0 / 5.0 + 32.0, v * 0.621371) - 32.0) * 5.0 / 9.0
    return F.when((t < 10) & (v > 4.8), value).otherwise(t)


def wind_chill_fahrenheit(t_f: Column, mph: Column) -> Column:
    return F.when((t_f > 50) | (mph < 3), t_f).otherwise(_imperial(t_f, mph))


def wrap_degrees(delta: Column) -> Column:
    """Angle difference folded to [-180, 180)."""
    return F.pmod(delta + 180, F.lit(360.0)) - 180


def frontal_score(dt: Column, ddir: Column, dp: Column) -> Column:
    turn = F.abs(ddir)
    score = (
        F.when(dt < -2, 0.3).when(dt < -1, 0.15).otherwise(0.0)
        + F.when(turn > 45, 0.3).when(turn > 20, 0.15).otherwise(0.0)
        + F.when(dp > 100, 0.3).when(dp > 50, 0.15).otherwise(0.0)
        + F.when((dt < -1) & (turn > 30) & (dp > 50), 0.1).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def ramp_down_risk(change: Column, hour: Column, dark: Column) -> Column:
    score = (
        F.when(change < -1000, 0.15).otherwise(0.0)
        + F.when(change < -2000, 0.20).otherwise(0.0)
        + F.when(change < -3000, 0.20).otherwise(0.0)
        + F.when(change < -5000, 0.15).otherwise(0.0)
        + F.when(dark, 0.15).otherwise(0.0)
        + F.when(dark & hour.between(17, 21), 0.15).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def clean_market_keys(df: DataFrame, points: list[str], hour="hour", repeated="repeated", date="date", point="point") -> DataFrame:
    """Typed market keys from loosely formatted text columns, plus a known-point flag."""
    name = F.upper(F.trim(F.col(point)))
    return df.withColumns(
        {
            "delivery_hour": F.split_part(F.trim(F.col(hour)), F.lit(":"), F.lit(1)).try_cast("int"),
            "repeated_hour": F.upper(F.trim(F.col(repeated))).isin("Y", "TRUE").cast("int"),
            "delivery_date": F.coalesce(
                F.try_to_timestamp(F.col(date), F.lit("MM/dd/yyyy")), F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd"))
            ).cast("date"),
            "settlement_point": name,
            "known_point": flag(name.isin(points)),
        }
    )


def _folded(lon: Column) -> Column:
    """Longitudes of 0 to 360 as -180 to 180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def region_assign(points: DataFrame, boxes: DataFrame, lat: str, lon: str, whole: str = "all", cell: float = 1.0) -> DataFrame:
    """Every box a point falls in (boxes may overlap) plus the whole-area row.

    ``boxes`` carries region, lat_min, lat_max, lon_min, lon_max, weight. Longitudes of points and boxes may be 0 to 360; a box whose folded west edge lies
    east of its east edge goes over the date line and is taken as its two halves. Points and boxes meet by an equi join on grid cells of ``cell``
    degrees: a box stands in each cell that it touches, a point in one. The exact test follows, so boxes may be as many as points. The whole area
    is the span of all (folded) edges, one row. Points without a position fall in no box.
    """
    west, east = _folded(F.col("lon_min")), _folded(F.col("lon_max"))
    parts = F.when(west > east, F.array(F.struct(west.alias("_w"), F.lit(180.0).alias("_e")), F.struct(F.lit(-180.0).alias("_w"), east.alias("_e")))).otherwise(
        F.array(F.struct(west.alias("_w"), east.alias("_e")))
    )
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    split = boxes.select("region", "weight", F.col("lat_min").alias("_s"), F.col("lat_max").alias("_n"), F.inline(parts)).filter("_s <= _n AND _w <= _e")
    placed = split.withColumn("_cy", F.explode(F.sequence(at(F.col("_s")), at(F.col("_n"))))).withColumn("_cx", F.explode(F.sequence(at(F.col("_w")), at(F.col("_e")))))
    y, x = F.col(lat).cast("double"), _folded(F.col(lon).cast("double"))
    pts = points.withColumns({"_y": y, "_x": x}).filter("_y IS NOT NULL AND _x IS NOT NULL AND NOT isnan(_y) AND NOT isnan(_x)")
    celled = pts.withColumns({"_cy": at(F.col("_y")), "_cx": at(F.col("_x"))})
    inside = celled.join(placed, ["_cy", "_cx"]).filter("_y BETWEEN _s AND _n AND _x BETWEEN _w AND _e").select(*points.columns, "region", "weight")
    area = split.agg(F.min("_s").alias("_s"), F.max("_n").alias("_n"), F.min("_w").alias("_w"), F.max("_e").alias("_e"))
    covered = with_one_row(pts, area).filter("_y BETWEEN _s AND _n AND _x BETWEEN _w AND _e")
    return inside.unionByName(covered.select(*points.columns, F.lit(whole).alias("region"), F.lit(1.0).alias("weight")))


def narrow_types(df: DataFrame, dates=(), flags=(), measures=()) -> DataFrame:
    cast = {c: F.col(c).cast("string") for c in dates}
    cast.update({c: F.col(c).cast("tinyint") for c in flags})
    cast.update({c: F.col(c).cast("float") for c in measures})
    return df.withColumns(cast)


def zone_station(points: DataFrame, stations: DataFrame, point: str, fallback: str = "austin") -> DataFrame:
    """Station of a point from a lookup table keyed by point; unknown points get ``fallback``."""
    looked = points.join(stations, point, "left")
    return looked.withColumn("station", F.coalesce("station", F.lit(fallback)))


def hour_probability(df: DataFrame, train: DataFrame, hour: str, label: str, missing: float = 0.0) -> DataFrame:
    """Training rate of the label per hour looked up for every row (24 lookup rows at most)."""
    rates = train.groupBy(hour).agg(F.avg(F.col(label).cast("double")).alias("hour_spike_prob"))
    return df.join(F.broadcast(rates), hour, "left").na.fill(missing, subset=["hour_spike_prob"])
