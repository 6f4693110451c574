"""Aggregations, audits, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import rules
from ..operators import aggregate as agg
from ..operators import align, audit, dedup, ranked
from . import base, models
from .alignment import POINTS, RES15, r2, reserves_15min
from .ingest import HISTORY, market_history
from .registry import query
from .rules import WIND_PHYSICS, boxes, case_map, loc, wind_cells


@query("rtm_hourly_avg", text="point", times="hour_start", nums="lmp",
       sql="SELECT point, date_trunc('hour', t) AS hour_start, avg(price) AS lmp FROM b_rtm15 GROUP BY 1, 2")
def rtm_hourly_avg(spark, d):
    return agg.hourly_average(base.b_rtm15(spark, d), ["point"], "t", "price")


@query(
    "rtm_hourly_multi", text="point", times="hour_start", nums="rtm_mean rtm_max rtm_min rtm_last rtm_std spread", ints="spread_class",
    sql="""SELECT *, rtm_mean - hub AS spread, CASE WHEN rtm_mean - hub <= -20 THEN 0 WHEN rtm_mean - hub <= -5 THEN 1 WHEN rtm_mean - hub <= 5
      THEN 2 WHEN rtm_mean - hub <= 20 THEN 3 ELSE 4 END AS spread_class FROM (SELECT point, date_trunc('hour', t) AS hour_start,
      avg(price) AS rtm_mean, max(price) AS rtm_max, min(price) AS rtm_min, arg_max(price, t) AS rtm_last, stddev_samp(price) AS rtm_std
      FROM b_rtm15 GROUP BY 1, 2 HAVING count(*) = 4) JOIN b_hub1h ON hour_start = b_hub1h.t""",
)
def rtm_hourly_multi(spark, d):
    h = agg.hourly_multi(base.b_rtm15(spark, d), ["point"], "t", "price")
    hub = base.b_hub1h(spark, d).withColumnRenamed("t", "hour_start")
    j = h.join(hub, "hour_start").withColumn("spread", F.col("rtm_mean") - F.col("hub"))
    return j.withColumn("spread_class", rules.spread_class(F.col("spread")))


PARTS = """CASE WHEN hour(l) = 0 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS delivery_date,
   CASE WHEN hour(l) = 0 THEN 24 ELSE hour(l) END AS delivery_hour, minute(l) // 15 + 1 AS delivery_interval"""


@query(
    "backfill_15min_avg", text="point", dates="delivery_date", ints="delivery_hour delivery_interval repeated_hour", nums="lmp",
    sql=f"""SELECT point, {PARTS}, 0 AS repeated_hour, {r2("avg(price)")} AS lmp FROM (SELECT point, price, {loc("t")} AS l FROM
      (SELECT point, t, CASE WHEN minute(t) < 30 THEN price + 1 ELSE price END AS price FROM b_rtm5)) GROUP BY ALL""",
)
def backfill_15min_avg(spark, d):
    r = base.b_rtm5(spark, d)
    api = r.filter(F.minute("t") < 30).withColumn("price", F.col("price") + 1)
    merged = dedup.first_source_wins([api, r], ["point", "t"])
    return agg.market_bucket_average(merged, "point", "t", "price")


@query(
    "backfill_dam", text="settlement_point", dates="delivery_date", ints="hour_ending", nums="lmp",
    sql=f"""SELECT settlement_point, delivery_date, hour_ending, CASE WHEN delivery_date >= DATE '2024-01-15' THEN lmp + 2 ELSE lmp END AS lmp
      FROM ({HISTORY})""",
)
def backfill_dam(spark, d):
    hist = market_history(spark, d).withColumn("seq", F.lit(0))
    batch = hist.filter(F.col("delivery_date") >= "2024-01-15").withColumns({"lmp": F.col("lmp") + 2, "seq": F.lit(1)})
    return dedup.upsert(hist, batch, ["settlement_point", "delivery_date", "hour_ending", "repeated_hour"], "seq")


@query(
    "components_hourly", text="point", times="hour_start", nums="price energy congestion loss",
    sql="""SELECT point, hour_start, avg(price) AS price, avg(energy) AS energy, avg(congestion) AS congestion, avg(loss) AS loss FROM (
      SELECT point, time_bucket(INTERVAL '5 minutes', ts) AS t5, date_trunc('hour', ts) AS hour_start, avg(price) AS price, avg(price - k / 10) AS energy,
      avg(k / 15) AS congestion, avg(k / 30) AS loss FROM b_ev GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def components_hourly(spark, d):
    e = base.b_ev(spark, d).withColumns(
        {"energy": F.col("price") - F.col("k") / 10, "congestion": F.col("k") / 15, "loss": F.col("k") / 30}
    )
    cols = ["price", "energy", "congestion", "loss"]
    return agg.average_of_averages(e, ["point"], cal.floor_time(F.col("ts"), 5), cal.floor_time(F.col("ts"), 60), cols)


FUEL_HE = "delivery_date, (interval_15min - 1) // 4 + 1 AS hour_ending"
_PCT = [f"{g}_pct" for g in rules.COARSE_GROUPS]


@query(
    "fuel_pct_hourly", dates="delivery_date", ints="hour_ending", nums=" ".join(_PCT),
    sql=f"SELECT {FUEL_HE}, " + ", ".join(
        f"coalesce(sum(mw) FILTER (g = '{g}'), 0) / nullif(sum(mw), 0) * 100 AS {g}_pct" for g in rules.COARSE_GROUPS)
    + f" FROM (SELECT *, {case_map('fuel', rules.FUEL_GROUPS)} AS g FROM b_fuel) WHERE g IS NOT NULL GROUP BY 1, 2",
)
def fuel_pct_hourly(spark, d):
    return agg.fuel_pct_hourly(base.b_fuel(spark, d))


_MW = [f"{g}_gen_mw" for g in rules.EXPANDED_GROUPS]
FUEL_MW = (
    f"SELECT *, {' + '.join(_MW)} AS total_gen_mw FROM (SELECT {FUEL_HE}, "
    + ", ".join(f"coalesce(sum(mw) FILTER (g = '{g}'), 0) AS {g}_gen_mw" for g in rules.EXPANDED_GROUPS)
    + f" FROM (SELECT *, {case_map('fuel', rules.FUEL_GROUPS_EXPANDED)} AS g FROM b_fuel) WHERE g IS NOT NULL GROUP BY 1, 2)"
)


@query("fuel_mw_hourly", dates="delivery_date", ints="hour_ending", nums=" ".join(_MW) + " total_gen_mw", sql=FUEL_MW)
def fuel_mw_hourly(spark, d):
    return agg.fuel_mw_hourly(base.b_fuel(spark, d))


def _slots_sql(where=""):
    return f"""SELECT {FUEL_HE}, avg(mw) AS mw FROM (SELECT delivery_date, interval_15min, sum(mw) AS mw FROM b_fuel {where} GROUP BY 1, 2)
      GROUP BY 1, 2"""


@query("system_load_hourly", dates="delivery_date", ints="hour_ending", nums="mw", sql=_slots_sql())
def system_load_hourly(spark, d):
    return agg.slot_sum_hour_mean(base.b_fuel(spark, d))


@query("wind_generation_hourly", dates="delivery_date", ints="hour_ending", nums="mw", sql=_slots_sql("WHERE fuel IN ('Wind', 'Wnd')"))
def wind_generation_hourly(spark, d):
    return agg.slot_sum_hour_mean(base.b_fuel(spark, d), ["Wind", "Wnd"])


@query("resample_last_15min", times="t", nums="prc lam adder", sql=RES15)
def resample_last_15min(spark, d):
    return reserves_15min(spark, d)


@query(
    "resample_hourly", text="point", times="hour_start", nums="mean first last max min",
    sql="""SELECT point, g.t AS hour_start, a.* EXCLUDE (point, t) FROM (SELECT point, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t
      FROM b_rtm1h GROUP BY 1) g LEFT JOIN (SELECT point, date_trunc('hour', ts) AS t, avg(price) AS mean, arg_min(price, ts) AS first,
      arg_max(price, ts) AS last, max(price) AS max, min(price) AS min FROM b_ev GROUP BY 1, 2) a USING (point, t)""",
)
def resample_hourly(spark, d):
    return agg.resample_hourly(base.b_ev(spark, d), ["point"], "ts", "price")


@query(
    "pivot_first", times="t", nums=" ".join(POINTS),
    sql="SELECT time_bucket(INTERVAL '15 minutes', ts) AS t, " + ", ".join(
        f"arg_min(price, ts) FILTER (point = '{p}') AS {p}" for p in POINTS) + " FROM b_ev GROUP BY 1",
)
def pivot_first(spark, d):
    e = base.b_ev(spark, d).withColumn("t", cal.floor_time(F.col("ts"), 15))
    return agg.pivot_first(e, ["t"], "point", POINTS, "price", F.col("ts"))


@query(
    "latest_posting", text="point", times="t", nums="price k",
    sql="""SELECT point, date_trunc('hour', ts) AS t, arg_max(price, ts) FILTER (k >= 30) AS price, arg_max(k, ts) FILTER (price < 60) AS k
      FROM b_ev GROUP BY 1, 2""",
)
def latest_posting(spark, d):
    e = base.b_ev(spark, d).select(
        "point", cal.floor_time(F.col("ts"), 60).alias("t"), "ts",
        F.when(F.col("k") >= 30, F.col("price")).alias("price"), F.when(F.col("price") < 60, F.col("k")).alias("k"),
    )
    return dedup.keep_last_non_null(e, ["point", "t"], F.col("ts"), ["price", "k"])


@query(
    "unpivot_regions", times="t", text="region", nums="gen stwpf wgrpp cop_hsl",
    sql="""SELECT h.t, r.region, avg(price) FILTER (point = region) AS gen, max(price) FILTER (point = region) AS stwpf,
      min(price) FILTER (point = region) AS wgrpp, avg(k) FILTER (point = region) AS cop_hsl FROM (SELECT *, date_trunc('hour', ts) AS t FROM b_ev) h,
      (VALUES ('click'), ('view'), ('error'), ('signup')) AS r(region) GROUP BY 1, 2""",
)
def unpivot_regions(spark, d):
    regions, t = ["click", "view", "error", "signup"], cal.floor_time(F.col("ts"), 60)
    aggs = []
    for r in regions:
        p, k = F.when(F.col("point") == r, F.col("price")), F.when(F.col("point") == r, F.col("k"))
        aggs += [F.avg(p).alias(f"gen_{r}"), F.max(p).alias(f"stwpf_{r}"), F.min(p).alias(f"wgrpp_{r}"), F.avg(k).alias(f"cop_hsl_{r}")]
    wide = base.b_ev(spark, d).groupBy(t.alias("t")).agg(*aggs)
    return agg.unpivot_regions(wide, ["t"], regions, ["gen", "stwpf", "wgrpp", "cop_hsl"])


@query(
    "price_statistics", text="point", nums="mean std min max median range q25 q75",
    sql="""SELECT point, avg(price) AS mean, stddev_pop(price) AS std, min(price) AS min, max(price) AS max, median(price) AS median,
      max(price) - min(price) AS range, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75 FROM b_ev GROUP BY 1""",
)
def price_statistics(spark, d):
    return agg.price_statistics(base.b_ev(spark, d), ["point"], "price")


@query(
    "threshold_stats", text="point", dates="d", ints="n n_over", nums="share_over mean_under mean_all hours_over",
    sql="""SELECT point, CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (price > 60) AS n_over,
      CAST(count(*) FILTER (price > 60) AS DOUBLE) / count(*) AS share_over, avg(price) FILTER (price <= 60) AS mean_under, avg(price) AS mean_all,
      CAST(count(*) FILTER (price > 60) AS DOUBLE) / 12 AS hours_over FROM b_ev GROUP BY 1, 2""",
)
def threshold_stats(spark, d):
    return agg.threshold_stats(base.b_ev(spark, d).withColumn("d", F.col("ts").cast("date")), ["point", "d"], "price")


WEIGHTS = "SELECT point, sum(price) / (SELECT sum(price) FROM b_ev) AS weight FROM b_ev GROUP BY 1"


@query("load_zone_weights", text="point", nums="weight", sql=WEIGHTS)
def load_zone_weights(spark, d):
    return agg.zone_weights(base.b_ev(spark, d), "point", "price")


@query(
    "weighted_weather", times="t", nums="temp wind pressure",
    sql=f"""SELECT t, sum(temp * weight) / sum(weight) AS temp, sum(wind * weight) / sum(weight) AS wind, sum(pressure * weight) / sum(weight) AS pressure
      FROM b_wx JOIN ({WEIGHTS}) ON station = point GROUP BY 1""",
)
def weighted_weather(spark, d):
    w = agg.zone_weights(base.b_ev(spark, d), "point", "price").withColumnRenamed("point", "station")
    return agg.weighted_mean(base.b_wx(spark, d), w, "station", ["t"], ["temp", "wind", "pressure"])


_RS = ["ws_80m", "normalized_power"]
_RM = ["wind_shear", "power_density"]


@query(
    "regional_grid_stats", text="region", times="t",
    nums=" ".join([f"{c}_{s}" for c in _RS for s in ("mean", "std", "min", "max")] + [f"{c}_mean" for c in _RM]),
    sql="SELECT region, t, " + ", ".join(
        f"{f}({c}) AS {c}_{s}" for c in _RS for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    + ", " + ", ".join(f"avg({c}) AS {c}_mean" for c in _RM) + f" FROM ({WIND_PHYSICS}) GROUP BY 1, 2",
)
def regional_grid_stats(spark, d):
    cells = rules.wind_physics_features(wind_cells(spark, d), "u10", "v10", "u80", "v80", "sp", "tk")
    return agg.regional_stats(cells, ["region", "t"], _RS, _RM)


@query("distinct_points", text="point", times="first_time last_time", ints="n",
       sql="SELECT point, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM b_ev GROUP BY 1")
def distinct_points(spark, d):
    return audit.coverage(base.b_ev(spark, d), "point", "ts").orderBy("point")


@query(
    "audit_overview", text="table_name", ints="n", times="first_time last_time",
    sql=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n, min({c}) AS first_time, max({c}) AS last_time FROM {t}"
        for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))),
)
def audit_overview(spark, d):
    cols = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    return audit.overview({t: (base.read(spark, d, t), c) for t, c in cols.items()})


PRIO_DAYS = "SELECT DISTINCT o_orderpriority AS point, CAST(o_orderdate AS DATE) AS d FROM orders"
DAY_RANGE = "SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM b_dam_d"


@query(
    "audit_missing_dates", text="point", dates="d",
    sql=f"SELECT point, d FROM (SELECT DISTINCT o_orderpriority AS point FROM orders), ({DAY_RANGE}) EXCEPT ({PRIO_DAYS})",
)
def audit_missing_dates(spark, d):
    o = base.read(spark, d, "orders").select(F.col("o_orderpriority").alias("point"), F.col("o_orderdate").cast("date").alias("d"))
    return audit.missing_dates(o, "point", "d")


@query(
    "audit_interval_gaps", text="point", dates="d", ints="n missing",
    sql="""SELECT point, g.d, coalesce(n, 0) AS n, 24 - coalesce(n, 0) AS missing FROM (SELECT DISTINCT point, x.d FROM b_rtm1h,
      (SELECT CAST(unnest(generate_series(min(CAST(t AS DATE)), max(CAST(t AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM b_rtm1h) x) g
      LEFT JOIN (SELECT point, CAST(t AS DATE) AS d, count(DISTINCT hour(t)) AS n FROM b_rtm1h GROUP BY 1, 2) c USING (point, d)
      WHERE coalesce(n, 0) < 24""",
)
def audit_interval_gaps(spark, d):
    r = base.b_rtm1h(spark, d).withColumns({"d": F.col("t").cast("date"), "h": F.hour("t")})
    return audit.interval_gaps(r, "point", "d", "h", 24)


_SV = ["regup", "regdn", "rrs", "nspin", "ecrs"]


@query(
    "audit_nulls", text="column_name", ints="n_null",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM b_asmcpc_d" for c in _SV),
)
def audit_nulls(spark, d):
    return audit.null_counts(base.b_asmcpc_d(spark, d), _SV)


@query(
    "audit_duplicates", ints="n_duplicate_groups",
    sql="SELECT count(*) AS n_duplicate_groups FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def audit_duplicates(spark, d):
    return audit.duplicate_groups(base.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "audit_anomalies", text="point", ints="n_negative n_zero n_high n_low", nums="min max avg",
    sql="""SELECT point, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x > 250) AS n_high,
      count(*) FILTER (x < -20) AS n_low, min(x) AS min, max(x) AS max, avg(x) AS avg FROM (SELECT point, price - 25 AS x FROM b_ev) GROUP BY 1""",
)
def audit_anomalies(spark, d):
    e = base.b_ev(spark, d).withColumn("x", F.col("price") - 25)
    return audit.anomalies(e, "x", high=250.0, low=-20.0, keys=["point"])


@query("audit_coverage", text="point", ints="n", times="first_time last_time",
       sql="SELECT point, count(*) AS n, min(t) AS first_time, max(t) AS last_time FROM b_rtm15 GROUP BY 1")
def audit_coverage(spark, d):
    return audit.coverage(base.b_rtm15(spark, d), "point", "t")


@query(
    "audit_boundary_gap", text="point", times="history_end live_start", nums="gap_hours",
    sql="""SELECT point, history_end, live_start, date_diff('second', history_end, live_start) / CAST(3600 AS DOUBLE) AS gap_hours FROM (
      SELECT point, max(t) FILTER (price > 80 AND t < TIMESTAMP '2024-01-15') AS history_end, min(t) FILTER (price > 80 AND t >= TIMESTAMP '2024-01-15')
      AS live_start FROM b_rtm15 GROUP BY 1)""",
)
def audit_boundary_gap(spark, d):
    r = base.b_rtm15(spark, d).filter("price > 80")
    return audit.boundary_gap(r.filter(F.col("t") < "2024-01-15"), r.filter(F.col("t") >= "2024-01-15"), "point", "t")


@query(
    "latest_complete_day", times="t", nums="hub",
    sql="""SELECT t, hub FROM b_hub1h WHERE CAST(t AS DATE) = (SELECT max(d) FROM (SELECT CAST(t AS DATE) AS d FROM b_hub1h GROUP BY 1
      HAVING count(DISTINCT hour(t)) >= 24))""",
)
def latest_complete_day(spark, d):
    h = base.b_hub1h(spark, d).withColumns({"d": F.col("t").cast("date"), "h": F.hour("t")})
    return agg.latest_complete_day(h, "d", "h").orderBy("t")


@query(
    "split_by_date", dates="d", text="split ratio_split", ints="fold",
    sql="""SELECT d, CASE WHEN d < DATE '1998-01-01' THEN 'train' WHEN d < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split,
      CASE WHEN row_number() OVER (ORDER BY d) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS ratio_split,
      ntile(5) OVER (ORDER BY d) AS fold FROM b_dam_d""",
)
def split_by_date(spark, d):
    days = base.b_dam_d(spark, d)
    numbered = ranked.ordered_splits(days, [], F.trunc("d", "month"), [F.col("d")], ratio=0.8, folds=5)
    return numbered.withColumn("split", agg.split_by_date(F.col("d"), "1998-01-01", "2000-01-01"))


# --- sorts, limits, top-k -------------------------------------------------------------------------


@query(
    "recent_pairs_top48", text="point", times="t", nums="pred actual",
    sql=f"SELECT point, t, {r2('pred')} AS pred, {r2('actual')} AS actual FROM b_err ORDER BY t DESC, point LIMIT 48",
)
def recent_pairs_top48(spark, d):
    top = base.b_err(spark, d).orderBy(F.desc("t"), "point").limit(48)
    return top.select("point", "t", align.two_decimals(F.col("pred")).alias("pred"), align.two_decimals(F.col("actual")).alias("actual"))


@query("alerts_ranked", ints="doc_id", nums="p", sql="SELECT doc_id, p FROM b_score WHERE p >= 0.6")
def alerts_ranked(spark, d):
    return base.b_score(spark, d).filter("p >= 0.6").orderBy(F.desc_nulls_last("p"), "doc_id")


@query(
    "top_drivers", text="point feature", ints="rank", nums="gain",
    sql=f"""SELECT point, feature, gain, row_number() OVER (PARTITION BY point ORDER BY gain DESC, feature) AS rank FROM ({models.GAINS}) WHERE horizon = 1 QUALIFY rank <= 5""",
)
def top_drivers(spark, d):
    """The features that weigh most in each point's fitted model of the next hour."""
    return ranked.top_per_key(models.gains(spark, d).filter("horizon = 1"), ["point"], [F.desc("gain"), F.col("feature")], 5)


@query("latest_row", text="point", ints="event_id", nums="price", times="ts",
       sql="SELECT point, arg_max(event_id, ts) AS event_id, arg_max(price, ts) AS price, max(ts) AS ts FROM b_ev GROUP BY 1")
def latest_row(spark, d):
    return dedup.keep_last(base.b_ev(spark, d).select("point", "event_id", "price", "ts"), ["point"], [F.col("ts")])


# --- set operations -------------------------------------------------------------------------------


@query("union_by_name", text="station", times="t", nums="temp extra",
       sql="""SELECT station, t, temp, CASE WHEN station = 'view' THEN wind END AS extra FROM b_wx""")
def union_by_name(spark, d):
    from ..sources.scan import union_with_drift

    wx = base.b_wx(spark, d)
    parts = [wx.filter(F.col("station") == s).select("station", "t", "temp", *([F.col("wind").alias("extra")] if s == "view" else [])) for s in POINTS]
    return union_with_drift(parts)


@query(
    "distinct_keep_last", ints="l_orderkey l_linenumber n", nums="l_extendedprice",
    sql="""SELECT l_orderkey, l_linenumber, l_extendedprice, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
      WHERE rn = 1""",
)
def distinct_keep_last(spark, d):
    li = base.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber"]
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return dedup.keep_last(li, keys, order, count="n")


@query("date_set_difference", dates="d", sql=f"({DAY_RANGE}) EXCEPT SELECT d FROM b_dam_d")
def date_set_difference(spark, d):
    days = base.b_dam_d(spark, d).select("d")
    full = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    return full.exceptAll(days)
