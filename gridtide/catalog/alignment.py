"""Joins, merges and as-of alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import rules
from ..functions.frames import exact_mean, series
from ..operators import align, dedup, fill
from . import base
from ..operators.ranked import in_blocks
from .registry import query
from .rules import LOCAL_CASES

POINTS = ["click", "error", "purchase", "signup", "view"]


def r2(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DECIMAL(20,8)), 2) AS DOUBLE)"


@query("join_dam_rtm", dates="d", nums="dam rtm", sql="SELECT d, dam, rtm FROM b_sys_d")
def join_dam_rtm(spark, d):
    rtm = base._line(spark, d).groupBy("d").agg((exact_mean(F.col("l_extendedprice")) / 997).alias("rtm"))
    return align.join_one_to_one(base.b_dam_d(spark, d), rtm, ["d"])


@query(
    "join_left_preagg", text="point", dates="d", nums="rtm price",
    sql="""SELECT point, d, rtm, price FROM b_rtm_d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) / 997 AS price
      FROM orders GROUP BY 1) USING (d)""",
)
def join_left_preagg(spark, d):
    o = base.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("price"))
    joined = align.join_left_mean(base.b_rtm_d(spark, d), o, ["d"], ["price"])
    return joined.withColumn("price", F.col("price") / 997)


@query(
    "join_left_keep_last", text="point", dates="d", nums="rtm price", ints="o_orderkey",
    sql="""SELECT point, d, rtm, price, o_orderkey FROM b_rtm_d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS o_orderkey,
      arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) USING (d)""",
)
def join_left_keep_last(spark, d):
    o = base.read(spark, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("d"), "o_orderkey", F.col("o_totalprice").alias("price")
    )
    return align.join_left_last(base.b_rtm_d(spark, d), o, ["d"], [F.col("o_orderkey")])


@query(
    "grid_left_join", dates="d", ints="hour_ending", times="dt", nums="price",
    sql=f"""SELECT g.d, g.he AS hour_ending, g.dt, p.price FROM (SELECT d, he, CASE WHEN v1 THEN u1 WHEN v0 THEN u0 END - INTERVAL 1 HOUR AS dt
      FROM ({LOCAL_CASES.replace(", h FROM", ", he FROM")} (SELECT d, he, CAST(d AS TIMESTAMP) + to_hours(he % 24) AS l FROM
      (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM b_dam_d), range(1, 25) AS r(he)))
      WHERE v0 OR v1) AS g LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, o_custkey % 24 + 1 AS he, avg(o_totalprice) / 997 AS price
      FROM orders GROUP BY 1, 2) AS p ON g.d = p.d AND g.he = p.he""",
)
def grid_left_join(spark, d):
    o = base.read(spark, d, "orders").withColumns(
        {"d": F.col("o_orderdate").cast("date"), "hour_ending": (F.col("o_custkey") % 24 + 1).cast("int")}
    )
    prices = o.groupBy("d", "hour_ending").agg((F.avg("o_totalprice") / 997).alias("price"))
    days = o.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    return cal.market_hour_grid(days, "d").join(prices, ["d", "hour_ending"], "left")


@query(
    "asof_hourly_to_15min", text="point", times="t", nums="price dam",
    sql="""SELECT l.point, l.t, l.price, r.price AS dam FROM b_rtm15 AS l ASOF LEFT JOIN (SELECT * FROM b_rtm1h WHERE price > 30) AS r
      ON l.point = r.point AND l.t >= r.t""",
)
def asof_hourly_to_15min(spark, d):
    dam = base.b_rtm1h(spark, d).filter("price > 30").withColumnRenamed("price", "dam")
    return align.asof_backward(base.b_rtm15(spark, d), dam, ["point"], "t", ["dam"])


@query(
    "asof_weather_shift", text="point", times="t", nums="price temp wind",
    sql="""SELECT l.point, l.t, l.price, r.temp, r.wind FROM b_rtm15 AS l ASOF LEFT JOIN (SELECT station, t + INTERVAL 1 HOUR AS t, temp, wind
      FROM b_wx) AS r ON l.point = r.station AND l.t >= r.t""",
)
def asof_weather_shift(spark, d):
    wx = base.b_wx(spark, d).withColumnRenamed("station", "point")
    return align.asof_backward(base.b_rtm15(spark, d), wx, ["point"], "t", ["temp", "wind"], shift_hours=1)


RES15 = """SELECT time_bucket(INTERVAL '15 minutes', t) AS t, arg_max(prc, t) AS prc, arg_max(lam, t) AS lam,
   arg_max(adder, t) FILTER (adder IS NOT NULL) AS adder FROM b_res GROUP BY 1"""


def reserves_15min(spark, d):
    r = base.b_res(spark, d).withColumn("q", cal.floor_time(F.col("t"), 15))
    last = dedup.keep_last_non_null(r, ["q"], F.col("t"), ["prc", "lam", "adder"])
    return last.withColumnRenamed("q", "t")


@query(
    "asof_reserves", text="point", times="t", nums="prc lam adder",
    sql=f"SELECT l.point, l.t, r.prc, r.lam, r.adder FROM b_rtm15 AS l ASOF LEFT JOIN ({RES15}) AS r ON l.t >= r.t",
)
def asof_reserves(spark, d):
    return align.asof_backward(base.b_rtm15(spark, d), reserves_15min(spark, d), [], "t", ["prc", "lam", "adder"])


@query(
    "asof_wind", times="t", nums="wind_gen_lag1 wind_forecast_error",
    sql="""SELECT t, lag(gen) OVER (ORDER BY t) AS wind_gen_lag1, lag(gen - stwpf) OVER (ORDER BY t) AS wind_forecast_error FROM (
      SELECT l.t, r.gen, r.stwpf FROM b_hub15 AS l ASOF LEFT JOIN b_gen AS r ON l.t >= r.t)""",
)
def asof_wind(spark, d):
    a = align.asof_backward(base.b_hub15(spark, d), base.b_gen(spark, d), [], "t", ["gen", "stwpf"]).withColumn("sys", F.lit("all"))
    lags = lambda b, w: b.withColumns(
        {"wind_gen_lag1": F.lag("gen").over(w), "wind_forecast_error": F.lag(F.col("gen") - F.col("stwpf")).over(w)}
    )
    return in_blocks(a, ["sys"], "t", lags, 1)


@query(
    "left_join_labels", text="point regime", times="t", nums="price", ints="spike_event",
    sql="""SELECT l.point, l.t, l.price, r.spike_event, r.regime FROM b_rtm15 AS l LEFT JOIN (SELECT point, t, price > 150 AS spike_event,
      CASE WHEN price > 150 THEN 'Scarcity' ELSE 'Tight' END AS regime FROM b_rtm15 WHERE price > 50) AS r USING (point, t)""",
)
def left_join_labels(spark, d):
    r = base.b_rtm15(spark, d)
    labels = r.filter("price > 50").select(
        "point", "t", (F.col("price") > 150).alias("spike_event"), F.when(F.col("price") > 150, "Scarcity").otherwise("Tight").alias("regime")
    )
    return r.join(labels, ["point", "t"], "left")


@query(
    "join_weather_wind", text="kind station", times="t", nums="temp gen",
    sql="""SELECT 'inner' AS kind, station, t, temp, gen FROM b_wx JOIN (SELECT * FROM b_gen WHERE gen > 5000) USING (t)
      UNION ALL SELECT 'left', station, t, temp, gen FROM b_wx LEFT JOIN (SELECT * FROM b_gen WHERE gen > 5000) USING (t)""",
)
def join_weather_wind(spark, d):
    wx, gen = base.b_wx(spark, d), base.b_gen(spark, d).filter("gen > 5000")
    inner = wx.join(gen, "t").withColumn("kind", F.lit("inner"))
    return inner.unionByName(wx.join(gen, "t", "left").withColumn("kind", F.lit("left")))


def _pairs(spark, d):
    """Forecast and actual tables with one point stored as NULL."""
    e = base.b_err(spark, d)
    sp = F.when(F.col("point") != "error", F.col("point"))
    key = F.concat_ws("|", "point", F.col("t").cast("string"))
    both = e.select(
        key.alias("id"), sp.alias("settlement_point"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("target_time"), "pred", "actual", "t"
    )
    pred = both.select("id", "settlement_point", "target_time", F.col("pred").alias("predicted_value"))
    act = both.filter("actual > 20").select("id", "settlement_point", "target_time", F.col("actual").alias("actual_value"))
    done = both.filter(F.col("t") < "2024-01-04").select(F.col("id").alias("prediction_id"), F.col("id").alias("actual_id"))
    return pred, act, done


PAIRS = """SELECT CASE WHEN point <> 'error' THEN point END AS sp, strftime(t, '%Y-%m-%d %H:%M') AS target_time,
   pred - actual AS error, abs(pred - actual) AS abs_error, (pred - actual) / actual * 100 AS pct_error FROM b_err
   WHERE actual > 20 AND t >= TIMESTAMP '2024-01-04'"""


@query(
    "score_join_null_safe", text="settlement_point target_time", nums="error abs_error pct_error",
    sql=f"SELECT sp AS settlement_point, * EXCLUDE (sp) FROM ({PAIRS})",
)
def score_join_null_safe(spark, d):
    pred, act, done = _pairs(spark, d)
    return align.score_pairs(pred.withColumn("model", F.lit("rtm")), act.withColumn("market", F.lit("rtm")), done)


@query(
    "score_join_like", text="model market settlement_point target_time", nums="error abs_error pct_error",
    sql=f"""SELECT m AS model, k AS market, sp AS settlement_point, * EXCLUDE (sp, m, k) FROM ({PAIRS}),
      (VALUES ('rtm_24h', 'rtm'), ('dam_rtm_mix', 'rtm'), ('dam_rtm_mix', 'dam')) AS v(m, k) WHERE sp IS NOT NULL""",
)
def score_join_like(spark, d):
    pred, act, done = _pairs(spark, d)
    models = F.explode(F.array(F.lit("rtm_24h"), F.lit("dam_rtm_mix"), F.lit("load")))
    markets = F.explode(F.array(F.lit("rtm"), F.lit("dam")))
    return align.score_pairs_contains(pred.withColumn("model", models), act.withColumn("market", markets), done)


@query(
    "sync_missing_actuals", text="point", times="t", nums="price",
    sql="""SELECT point, t, price FROM b_rtm1h WHERE (point, t) NOT IN (SELECT point, t FROM b_rtm1h WHERE price > 60)""",
)
def sync_missing_actuals(spark, d):
    r = base.b_rtm1h(spark, d)
    return align.only_new(r, r.filter("price > 60"), ["point", "t"])


@query(
    "usage_log_join", ints="event_id user_id", text="c_name point", times="ts",
    sql="""SELECT event_id, user_id, c_name, point, ts FROM b_ev JOIN customer ON user_id = c_custkey
      WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'""",
)
def usage_log_join(spark, d):
    log = base.b_ev(spark, d).filter((F.col("ts") >= "2024-01-24") & (F.col("ts") < "2024-01-31"))
    keys = base.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return log.join(keys, "user_id").orderBy(F.desc("ts"), F.desc("event_id"))


@query(
    "merge_api_over_cdr", text="point", times="t", nums="price",
    sql="""SELECT point, t, coalesce(a.price, c.price) AS price FROM (SELECT point, t, price + 1 AS price FROM b_rtm5 WHERE minute(t) < 40) a
      FULL JOIN (SELECT * FROM b_rtm5 WHERE minute(t) >= 20) c USING (point, t)""",
)
def merge_api_over_cdr(spark, d):
    r = base.b_rtm5(spark, d)
    api = r.filter(F.minute("t") < 40).withColumn("price", F.col("price") + 1)
    return dedup.first_source_wins([api, r.filter(F.minute("t") >= 20)], ["point", "t"])


@query(
    "merge_cdr_over_hist", text="point", times="t", nums="price",
    sql="""SELECT point, t, coalesce(c.price, h.price) AS price FROM (SELECT point, date_trunc('hour', t) AS t, avg(price) AS price FROM b_rtm5
      WHERE t >= TIMESTAMP '2024-01-10' GROUP BY 1, 2) c FULL JOIN (SELECT point, t, price FROM b_rtm1h WHERE t < TIMESTAMP '2024-01-20') h USING (point, t)""",
)
def merge_cdr_over_hist(spark, d):
    live = base.b_rtm5(spark, d).filter(F.col("t") >= "2024-01-10")
    hourly = live.groupBy("point", cal.floor_time(F.col("t"), 60).alias("t")).agg(F.avg("price").alias("price"))
    hist = base.b_rtm1h(spark, d).filter(F.col("t") < "2024-01-20")
    return dedup.first_source_wins([hourly, hist], ["point", "t"])


@query(
    "fallback_4_sources", text="source", times="t", nums="price", ints="n_source",
    sql="""SELECT t, source, price, count(*) OVER (PARTITION BY source, CAST(t AS DATE)) AS n_source FROM (SELECT t, arg_min(point, o) AS source,
      arg_min(price, o) AS price FROM (SELECT *, CASE point WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS o
      FROM b_rtm5 WHERE point <> 'purchase') GROUP BY 1)""",
)
def fallback_4_sources(spark, d):
    r = base.b_rtm5(spark, d)
    sources = {p: r.filter(F.col("point") == p).select("t", "price") for p in ("view", "click", "signup", "error")}
    picked = align.fallback_sources(sources, ["t"]).withColumn("day", F.col("t").cast("date"))
    counts = picked.groupBy("day", "source").agg(F.count("*").alias("n_source"))
    return picked.join(counts, ["day", "source"])


@query(
    "fill_missing_only", text="point v", times="t",
    sql="""SELECT point, t, coalesce(a.v, b.v) AS v FROM (SELECT point, t, CASE WHEN price > 40 THEN CAST(CAST(floor(price) AS BIGINT) AS VARCHAR) END AS v
      FROM b_rtm1h WHERE t < TIMESTAMP '2024-01-20') a FULL JOIN (SELECT point, t, 'x' || CAST(hour(t) AS VARCHAR) AS v FROM b_rtm1h
      WHERE t >= TIMESTAMP '2024-01-10') b USING (point, t)""",
)
def fill_missing_only(spark, d):
    r = base.b_rtm1h(spark, d)
    have = r.filter(F.col("t") < "2024-01-20").select(
        "point", "t", F.when(F.col("price") > 40, F.floor("price").cast("bigint").cast("string")).otherwise(" ").alias("v")
    )
    other = r.filter(F.col("t") >= "2024-01-10").select("point", "t", F.concat(F.lit("x"), F.hour("t")).alias("v"))
    return align.fill_missing_only(have, other, ["point", "t"], "v")


@query(
    "time_shift_self_join", text="point", times="t", nums="price price_t1 price_t24",
    sql="""SELECT a.point, a.t, a.price, b.price AS price_t1, c.price AS price_t24 FROM b_rtm1h a LEFT JOIN b_rtm1h b ON a.point = b.point
      AND b.t = a.t - INTERVAL 1 HOUR LEFT JOIN b_rtm1h c ON a.point = c.point AND c.t = a.t - INTERVAL 24 HOUR""",
)
def time_shift_self_join(spark, d):
    return align.time_shift_join(base.b_rtm1h(spark, d), ["point"], "t", "price", [1, 24])


@query(
    "hour_prob_lookup", text="point", times="t", nums="hour_spike_prob",
    sql="""SELECT point, t, coalesce(p, 0.01) AS hour_spike_prob FROM b_rtm1h LEFT JOIN (SELECT hour(t) AS h, avg(CASE WHEN price > 80 THEN 1.0 ELSE 0 END)
      AS p FROM b_rtm1h WHERE t < TIMESTAMP '2024-01-15' AND hour(t) < 20 GROUP BY 1) ON hour(t) = h""",
)
def hour_prob_lookup(spark, d):
    r = base.b_rtm1h(spark, d).withColumn("hour_of_day", F.hour("t"))
    train = r.filter((F.col("t") < "2024-01-15") & (F.col("hour_of_day") < 20))
    return rules.hour_probability(r, train.withColumn("y", F.col("price") > 80), "hour_of_day", "y", missing=0.01)


@query(
    "zone_station_lookup", ints="event_id", text="point station",
    sql="""SELECT event_id, point, CASE point WHEN 'click' THEN 'midland' WHEN 'view' THEN 'houston' WHEN 'signup' THEN 'dallas' ELSE 'austin' END
      AS station FROM b_ev""",
)
def zone_station_lookup(spark, d):
    stations = spark.createDataFrame([("click", "midland"), ("view", "houston"), ("signup", "dallas")], "point STRING, station STRING")
    return rules.zone_station(base.b_ev(spark, d).select("event_id", "point"), stations, "point")


@query(
    "arbitrage_pairs", text="point", dates="d", ints="buy sell", nums="spread",
    sql="""WITH x AS (SELECT point, CAST(t AS DATE) AS d, hour(t) AS h, price FROM b_rtm1h) SELECT a.point, a.d, a.h AS buy, b.h AS sell,
      b.price - a.price AS spread FROM x a JOIN x b ON a.point = b.point AND a.d = b.d AND a.h < b.h WHERE b.price - a.price >= 60""",
)
def arbitrage_pairs(spark, d):
    r = base.b_rtm1h(spark, d).select("point", F.col("t").cast("date").alias("d"), F.hour("t").alias("h"), "price")
    pairs = align.arbitrage_pairs(r, ["point", "d"], "h", "price", 60.0)
    return pairs.orderBy("point", "d", F.desc("spread"), "buy", "sell")


@query(
    "chart_day_assembly", dates="d", ints="h", nums="rtm dam load wind",
    sql=f"""SELECT g.d, g.h, {r2("rtm")} AS rtm, {r2("dam")} AS dam, {r2("load")} AS load, {r2("wind")} AS wind FROM (
      SELECT DISTINCT CAST(t AS DATE) AS d, r.h FROM b_hub1h, range(24) AS r(h)) g
      LEFT JOIN (SELECT CAST(t AS DATE) AS d, hour(t) AS h, avg(price) AS rtm FROM b_rtm15 WHERE point = 'view' GROUP BY 1, 2) USING (d, h)
      LEFT JOIN (SELECT CAST(t AS DATE) AS d, hour(t) AS h, price AS dam FROM b_rtm1h WHERE point = 'click') USING (d, h)
      LEFT JOIN (SELECT CAST(t AS DATE) AS d, hour(t) AS h, gen AS load, stwpf AS wind FROM b_gen) USING (d, h)""",
)
def chart_day_assembly(spark, d):
    def keyed(df, **cols):
        return df.groupBy(F.col("t").cast("date").alias("d"), F.hour("t").alias("h")).agg(
            *[align.two_decimals(F.avg(c)).alias(n) for n, c in cols.items()]
        )

    hours = base.b_hub1h(spark, d).select(F.col("t").cast("date").alias("d")).distinct()
    grid = hours.select("d", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    feeds = [
        keyed(base.b_rtm15(spark, d).filter("point = 'view'"), rtm="price"),
        keyed(base.b_rtm1h(spark, d).filter("point = 'click'"), dam="price"),
        keyed(base.b_gen(spark, d), load="gen", wind="stwpf"),
    ]
    for f in feeds:
        grid = grid.join(f, ["d", "h"], "left")
    return grid


@query(
    "pivot_day_slots", times="slot", nums=" ".join(POINTS),
    sql="SELECT slot, " + ", ".join(f"arg_min(price, ts) FILTER (point = '{p}') AS {p}" for p in POINTS)
    + """ FROM (SELECT point, ts, price, CASE WHEN time_bucket(INTERVAL '5 minutes', ts) = ts THEN ts
      ELSE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE END AS slot FROM b_ev) GROUP BY 1""",
)
def pivot_day_slots(spark, d):
    e = base.b_ev(spark, d).withColumn("slot", align.slot_end(F.col("ts")))
    return align.pivot_slots(e, "slot", "point", POINTS, F.col("price"), F.col("ts"))
