"""Labels, runs, events and window identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import series
from ..operators import events
from ..operators.ranked import in_blocks, ordered_splits
from ..plans import generation, intraday, spike
from . import base
from .registry import query
from .sqltext import frame, lag, lead, part, roll

# --- spike labels on 15-minute prices against the hub ----------------------------------------------

J15 = "SELECT point, t, price AS lmp, hub, price - hub AS spread FROM b_rtm15 JOIN b_hub15 USING (t)"
LIM = {"p_hi": 110.0, "s_hi": 10.0, "rows": 960, "min_periods": 48, "p": 0.95}
Q95 = roll("quantile_cont", "lmp", 960, 0, 48).replace("quantile_cont(lmp)", "quantile_cont(lmp, 0.95)")
RAW = f"""SELECT *, coalesce((lmp >= 110 OR lmp >= q) AND abs(spread) >= 10, false) AS raw FROM (SELECT *, {Q95} AS q FROM ({J15}))"""
RUNS = f"""SELECT *, raw AND count(*) OVER (PARTITION BY point, id) >= 2 AS spike_event FROM (SELECT *, sum(ch) OVER (PARTITION BY point ORDER BY t
   ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, CASE WHEN raw = {lag("raw")} THEN 0 ELSE 1 END AS ch FROM ({RAW})))"""


def j15(spark, d):
    r = base.b_rtm15(spark, d).withColumnRenamed("price", "lmp")
    j = r.join(base.b_hub15(spark, d), "t")
    return j.withColumn("spread", F.col("lmp") - F.col("hub"))


def labelled(spark, d):
    return spike.spike_events(j15(spark, d), ["point"], "lmp", "hub", min_consecutive=2, **LIM)


@query(
    "rolling_quantile_flag", text="point", times="t", ints="flag",
    sql=f"SELECT point, t, coalesce(lmp >= 400 OR lmp >= q, false) AS flag FROM (SELECT *, {Q95} AS q FROM ({J15}))",
)
def rolling_quantile_flag(spark, d):
    j = spike.reaches_rolling_quantile(j15(spark, d), ["point"], "t", "lmp", F.col("lmp") < 400, "hit", 0.95, 960, 48)
    return j.withColumn("flag", (F.col("lmp") >= 400) | F.col("hit"))


@query("spike_event_runs", text="point", times="t", ints="raw spike_event", sql=RUNS)
def spike_event_runs(spark, d):
    return labelled(spark, d)


@query(
    "spike_event_trailing", text="point", times="t", ints="raw event",
    sql=f"""SELECT *, coalesce(sum(CAST(raw AS INTEGER)) OVER {frame(3)} >= 3, false) AS event FROM (SELECT point, t, lmp >= 60 AND (spread >= 5 OR lmp - price2 >= 8) AS raw
      FROM (SELECT j.*, coalesce(o.price, 1e9) AS price2 FROM ({J15}) j LEFT JOIN b_rtm15 o ON o.t = j.t AND o.point = 'view'))""",
)
def spike_event_trailing(spark, d):
    other = base.b_rtm15(spark, d).filter("point = 'view'").select("t", F.col("price").alias("price2"))
    j = j15(spark, d).join(other, "t", "left").na.fill(1e9, subset=["price2"])
    raw = (F.col("lmp") >= 60) & ((F.col("spread") >= 5) | (F.col("lmp") - F.col("price2") >= 8))
    j = j.withColumn("raw", raw)
    return j.withColumn("event", spike.spike_event_trailing(j, ["point"], "raw", 3))


@query("lead_label_exclusive", text="point", times="t", ints="lead",
       sql=f"""SELECT point, t, coalesce(max(CAST(spike_event AS INTEGER)) OVER (PARTITION BY point ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS lead
       FROM ({RUNS})""")  # fmt: skip
def lead_label_exclusive(spark, d):
    return labelled(spark, d).withColumn("lead", spike.lead_exclusive("spike_event", ["point"], 4))


@query("lead_label_inclusive", text="point", times="t", ints="lead",
       sql=f"""SELECT point, t, max(CAST(spike_event AS INTEGER)) OVER (PARTITION BY point ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS lead
       FROM ({RUNS})""")  # fmt: skip
def lead_label_inclusive(spark, d):
    return labelled(spark, d).withColumn("lead", spike.lead_inclusive("spike_event", ["point"], 4))


REGIME = "CASE WHEN spike_event THEN 'Scarcity' WHEN lmp >= 150 OR {s} >= 20 THEN 'Tight' ELSE 'Normal' END"


@query("market_regime", text="point regime regime_signed", times="t",
       sql=f"SELECT point, t, {REGIME.format(s='abs(spread)')} AS regime, {REGIME.format(s='spread')} AS regime_signed FROM ({RUNS})")
def market_regime(spark, d):
    x = labelled(spark, d)
    args = (F.col("lmp"), F.col("spread"), F.col("spike_event"))
    return x.withColumns({"regime": spike.market_regime(*args), "regime_signed": spike.market_regime(*args, signed=True)})


@query(
    "label_all_points", text="point regime", times="t", ints="spike_event lead_spike_60", nums="lmp hub spread",
    sql=f"""SELECT *, {REGIME.format(s='abs(spread)')} AS regime, coalesce(max(CAST(spike_event AS INTEGER)) OVER (PARTITION BY point ORDER BY t
      ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS lead_spike_60 FROM ({RUNS})""",
)
def label_all_points(spark, d):
    r = base.b_rtm15(spark, d).withColumnRenamed("price", "lmp")
    return spike.label_points(r, base.b_hub15(spark, d), **LIM)


@query(
    "next_hour_spike_label", text="point", times="t", ints="y",
    sql=f"""SELECT point, t, CASE WHEN n IS NOT NULL THEN CAST(n > greatest(60, 1.4 * coalesce(m, 0)) AS INTEGER) END AS y FROM (SELECT *,
      {lead("price")} AS n, {roll("avg", "price", 24, 1, 1)} AS m FROM b_rtm1h)""",
)
def next_hour_spike_label(spark, d):
    return base.b_rtm1h(spark, d).withColumn("y", spike.next_hour_spike("price", ["point"], fixed=60.0, multiple=1.4))


@query(
    "intervals_since_spike", text="point", times="t", ints="intervals_since_spike",
    sql=f"""SELECT point, t, rn - max(CASE WHEN price > 100 THEN rn END) OVER (PARTITION BY point ORDER BY t ROWS UNBOUNDED PRECEDING) AS intervals_since_spike
      FROM (SELECT *, row_number() OVER {part()} AS rn FROM b_rtm15)""",
)
def intervals_since_spike(spark, d):
    return intraday.intervals_since(base.b_rtm15(spark, d), ["point"], F.col("price") > 100)


# --- targets and baselines ---------------------------------------------------------------------------


@query("multi_horizon_targets", text="point", times="t", nums="target_1 target_4 target_24",
       sql=f"SELECT point, t, {lead('price', 1)} AS target_1, {lead('price', 4)} AS target_4, {lead('price', 24)} AS target_24 FROM b_rtm1h")
def multi_horizon_targets(spark, d):
    return intraday.multi_horizon(base.b_rtm1h(spark, d), ["point"], [1, 4, 24])


@query("rtm15_target", text="point", times="t", nums="actual_future_price target_delta",
       sql=f"SELECT point, t, {lead('price', 4)} AS actual_future_price, {lead('price', 4)} - price AS target_delta FROM b_rtm15")
def rtm15_target(spark, d):
    return intraday.targets(base.b_rtm15(spark, d), ["point"], 4)


@query(
    "naive_baseline", text="point", times="t", nums="naive_lag naive_yesterday naive_persistence naive_hour_mean",
    sql=f"""SELECT point, t, {lag("price", 4)} AS naive_lag, {lag("price", 24)} AS naive_yesterday, {lag("price", 1)} AS naive_persistence,
      avg(price) OVER (PARTITION BY point, hour(t) ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS naive_hour_mean FROM b_rtm1h""",
)
def naive_baseline(spark, d):
    return intraday.baselines(base.b_rtm1h(spark, d), ["point"], 4)


@query("forward_ramp", times="t", nums="ramp_1h ramp_down_1h ramp_3h ramp_down_3h",
       sql="SELECT t, " + ", ".join(
           f"coalesce(lead(gen, {h}) OVER (ORDER BY t) - gen, 0) AS ramp_{h}h, least(coalesce(lead(gen, {h}) OVER (ORDER BY t) - gen, 0), 0) AS ramp_down_{h}h"
           for h in (1, 3)) + " FROM b_gen")
def forward_ramp(spark, d):
    return in_blocks(gen(spark, d), ["sys"], "t", lambda g, w: generation.forward_ramp(g, ["sys"], "gen", [1, 3], w), 0, 3)


def gen(spark, d):
    return base.b_gen(spark, d).withColumn("sys", F.lit("all"))


_GRAD = "coalesce((lead({c}) OVER (ORDER BY t) - lag({c}) OVER (ORDER BY t)) / 2, lead({c}) OVER (ORDER BY t) - {c}, {c} - lag({c}) OVER (ORDER BY t))"


@query("gradient_acceleration", times="t", nums="change_rate acceleration",
       sql=f"SELECT *, {_GRAD.format(c='change_rate')} AS acceleration FROM (SELECT t, {_GRAD.format(c='gen')} AS change_rate FROM b_gen)")
def gradient_acceleration(spark, d):
    return in_blocks(gen(spark, d), ["sys"], "t", lambda g, w: generation.gradient_acceleration(g, ["sys"], "gen", w), 2, 2)


@query(
    "true_time_rolling", text="point", times="t", nums="price_mean_6h price_mean_24h",
    sql="SELECT point, t, " + ", ".join(
        f"avg(price * 0.7071067811865476) OVER (PARTITION BY point ORDER BY t RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS price_mean_{h}h"
        for h in (6, 24)) + " FROM b_rtm15",
)
def true_time_rolling(spark, d):
    return generation.true_time_rolling(base.b_rtm15(spark, d).withColumn("price", F.col("price") * 0.7071067811865476), ["point"], "price", [6, 24])


# --- events --------------------------------------------------------------------------------------------

SESS = """SELECT *, sum(st) OVER (PARTITION BY point ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM (SELECT *, CASE WHEN ts - lag(ts) OVER
   (PARTITION BY point ORDER BY ts) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS st FROM b_ev WHERE price > 60)"""


@query(
    "event_sessions", text="point", ints="n_events events_detected", nums="event_recall",
    sql=f"""SELECT point, count(*) AS n_events, sum(hit) AS events_detected, avg(hit) AS event_recall FROM (SELECT point, sess,
      max(CASE WHEN k >= 80 THEN 1 ELSE 0 END) AS hit FROM ({SESS}) GROUP BY 1, 2) GROUP BY 1""",
)
def event_sessions(spark, d):
    pos = base.b_ev(spark, d).filter("price > 60")
    s = events.sessions(pos, ["point"], "ts", 60, F.date_trunc("minute", "ts"))
    return events.event_recall(s, ["point"], "k", 80)


@query(
    "event_list", text="point", times='start end_time', ints="size",
    sql=f"""SELECT point, min(t) AS start, max(t) AS end_time, count(*) AS size FROM (SELECT *, sum(CASE WHEN pv IS NULL OR pt - pv > INTERVAL 180 MINUTE THEN 1 ELSE 0 END)
      OVER (PARTITION BY point ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, {lag("t")} AS pt, max(CASE WHEN price > 80 THEN t END) OVER
      (PARTITION BY point ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM b_rtm15) WHERE price > 80) GROUP BY point, id""",
)
def event_list(spark, d):
    r = base.b_rtm15(spark, d)
    return events.label_events(r, ["point"], F.col("price") > 80, 12, 15).withColumnRenamed("end", "end_time")


LEADS = f"""SELECT point, coalesce(rn - a, 0) AS lead FROM (SELECT *, min(CASE WHEN alarm THEN rn END) OVER {frame(13)} AS a, coalesce({lag("y")} = false, true) AS st
   FROM (SELECT point, t, actual > 90 AS y, pred > 58 AS alarm, row_number() OVER {part()} AS rn FROM b_err)) WHERE y AND st"""


@query(
    "lead_time_alarm", text="point", ints="max_lead n_detected n_events", nums="mean_lead median_lead detection_rate",
    sql=f"""SELECT point, avg(lead) AS mean_lead, median(lead) AS median_lead, max(lead) AS max_lead, count(*) FILTER (lead > 0) AS n_detected,
      count(*) AS n_events, CAST(count(*) FILTER (lead > 0) AS DOUBLE) / count(*) AS detection_rate FROM ({LEADS}) GROUP BY 1""",
)
def lead_time_alarm(spark, d):
    e = base.b_err(spark, d).withColumns({"y": (F.col("actual") > 90).cast("int"), "alarm": (F.col("pred") > 58).cast("int")})
    return events.lead_time_summary(events.lead_times(e, ["point"], "y", "alarm"), ["point"])


RAMPS = """WITH RECURSIVE s AS (SELECT point, t, price, row_number() OVER (PARTITION BY point ORDER BY t) - 1 AS i, price - lag(price, 3) OVER
   (PARTITION BY point ORDER BY t) AS chg, sign(lead(price) OVER (PARTITION BY point ORDER BY t) - price) AS ns FROM b_rtm1h),
   c AS (SELECT a.point, a.i, coalesce((SELECT min(b.i) FROM s b WHERE b.point = a.point AND b.i >= a.i AND (b.ns IS NULL OR b.ns <> (CASE WHEN a.chg < 0 THEN -1 ELSE 1 END))), a.i) AS e
   FROM s a WHERE abs(a.chg) >= 45), n AS (SELECT c.point, c.i, c.e, (SELECT min(x.i) FROM c x WHERE x.point = c.point AND x.i > c.e) AS nxt FROM c),
   r AS (SELECT point, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT n.point, n.nxt FROM r JOIN n ON n.point = r.point AND n.i = r.i WHERE n.nxt IS NOT NULL)
   SELECT n.point, n.i - 3 AS start_i, n.e AS end_i, f.t AS start_time, g.t AS end_time, g.price - f.price AS magnitude, n.e - n.i + 3 AS duration,
   (g.price - f.price) / (n.e - n.i + 3) AS rate, g.price < f.price AS is_ramp_down FROM r JOIN n ON n.point = r.point AND n.i = r.i
   JOIN s f ON f.point = n.point AND f.i = n.i - 3 JOIN s g ON g.point = n.point AND g.i = n.e"""


@query("ramp_events", text="point", ints="start_i end_i duration is_ramp_down", times="start_time end_time", nums="magnitude rate", sql=RAMPS)
def ramp_events(spark, d):
    return events.ramp_events(base.b_rtm1h(spark, d), ["point"], "price", 45.0)


def _ramp_pairs(spark, d):
    """Ramp events of actual and predicted series over thresholds and directions, found in one pass."""
    e = base.b_err(spark, d)
    guess = F.coalesce(F.lag("actual").over(series("point")), F.col("actual")) * 0.8 + F.col("pred") * 0.2
    sides = F.array(F.struct(F.lit(1).alias("is_true"), F.col("actual").alias("v")), F.struct(F.lit(0).alias("is_true"), F.col("guess").alias("v")))
    combos = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.lit(y).alias("direction")) for x in (30, 45) for y in ("up", "down", "both")])
    e = e.withColumn("guess", guess).withColumn("_s", F.explode(sides)).withColumn("_c", F.explode(combos))
    e = e.select("point", "t", "_s.is_true", "_s.v", "_c.threshold", "_c.direction")
    keys = ["point", "threshold", "direction"]
    return events.ramp_events(e, [*keys, "is_true"], "v", "threshold", direction="direction"), keys


_KEY, _SIDE = "point, threshold, direction", "point, threshold, direction, is_true"
_SER = f"(PARTITION BY {_SIDE} ORDER BY i"
_AHEAD = f"OVER {_SER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
#: Events of both sides by following the search from event to event, then predicted events matched one after the other; rows of (key, down, k, hits).
MATCHES = f"""WITH RECURSIVE o AS (SELECT point, t, actual, coalesce(lag(actual) OVER {part()}, actual) * 0.8 + pred * 0.2 AS guess FROM b_err),
 v AS (SELECT point, t, is_true, CASE is_true WHEN 1 THEN actual ELSE guess END AS v, CAST(x AS DOUBLE) AS threshold, direction FROM o,
   (VALUES (0), (1)) a(is_true), (VALUES (30), (45)) b(x), (VALUES ('up'), ('down'), ('both')) c(direction)),
 n AS (SELECT *, row_number() OVER (PARTITION BY {_SIDE} ORDER BY t) - 1 AS i FROM v),
 d AS (SELECT *, v - lag(v, 3) OVER {_SER}) AS chg, sign(lead(v) OVER {_SER}) - v) AS ns FROM n),
 f AS (SELECT *, coalesce(CASE direction WHEN 'up' THEN chg >= threshold WHEN 'down' THEN chg <= -threshold ELSE abs(chg) >= threshold END, false) AS found,
   min(CASE WHEN ns IS NULL OR ns <> -1 THEN i END) {_AHEAD} AS stop_down, min(CASE WHEN ns IS NULL OR ns <> 1 THEN i END) {_AHEAD} AS stop_up FROM d),
 g AS (SELECT *, CASE WHEN chg < 0 THEN stop_down ELSE stop_up END AS e, min(CASE WHEN found THEN i END) {_AHEAD} AS upcoming FROM f),
 j AS (SELECT x.*, y.upcoming AS nxt FROM g x LEFT JOIN g y ON {" AND ".join(f"y.{k} = x.{k}" for k in _SIDE.split(", "))} AND y.i = x.e + 1 WHERE x.found),
 r AS (SELECT {_SIDE}, min(i) AS i FROM j GROUP BY ALL UNION ALL SELECT {", ".join(f"j.{k}" for k in _SIDE.split(", "))}, j.nxt FROM r JOIN j USING ({_SIDE}, i) WHERE j.nxt IS NOT NULL),
 ev AS (SELECT {", ".join(f"r.{k}" for k in _SIDE.split(", "))}, r.i - 3 AS a, z.v < y.v AS down FROM r JOIN j USING ({_SIDE}, i)
   JOIN g y ON {" AND ".join(f"y.{k} = r.{k}" for k in _SIDE.split(", "))} AND y.i = r.i - 3 JOIN g z ON {" AND ".join(f"z.{k} = r.{k}" for k in _SIDE.split(", "))} AND z.i = j.e),
 p AS (SELECT *, row_number() OVER (PARTITION BY point, threshold, direction, down ORDER BY a) AS k FROM (SELECT x.point, x.threshold, x.direction, x.down, x.a,
   list_sort(list(y.a) FILTER (y.a IS NOT NULL)) AS near FROM ev x LEFT JOIN ev y ON y.is_true = 1 AND y.point = x.point AND y.threshold = x.threshold
   AND y.direction = x.direction AND y.down = x.down AND abs(y.a - x.a) <= 2 WHERE x.is_true = 0 GROUP BY ALL)),
 m AS (SELECT DISTINCT {_KEY}, down, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM p UNION ALL
   SELECT p.point, p.threshold, p.direction, p.down, p.k, CASE WHEN len(list_filter(p.near, lambda x: NOT list_contains(m.taken, x))) > 0
   THEN list_append(m.taken, list_filter(p.near, lambda x: NOT list_contains(m.taken, x))[1]) ELSE m.taken END
   FROM m JOIN p ON p.point = m.point AND p.threshold = m.threshold AND p.direction = m.direction AND p.down = m.down AND p.k = m.k + 1),
 h AS (SELECT {_KEY}, sum(n) AS hits FROM (SELECT {_KEY}, down, max(len(taken)) AS n FROM m GROUP BY ALL) GROUP BY ALL)
 SELECT {_KEY}, coalesce(hits, 0) AS hits, trues - coalesce(hits, 0) AS misses, guesses - coalesce(hits, 0) AS false_alarms FROM (SELECT {_KEY},
   count(*) FILTER (is_true = 1) AS trues, count(*) FILTER (is_true = 0) AS guesses FROM ev GROUP BY ALL) LEFT JOIN h USING ({_KEY})"""


@query("event_match_tolerance", text="point direction", nums="threshold", ints="hits misses false_alarms", sql=MATCHES)
def event_match_tolerance(spark, d):
    found, keys = _ramp_pairs(spark, d)
    return events.match_events(found, keys)


_PART = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


@query(
    "ramp_score", text="point direction", nums="threshold pod far csi bias miss_rate", ints="hits misses false_alarms",
    sql=f"""SELECT *, {_PART("hits", "hits + misses")} AS pod, {_PART("false_alarms", "hits + false_alarms")} AS far, {_PART("hits", "hits + misses + false_alarms")} AS csi,
      {_PART("hits + false_alarms", "hits + misses")} AS bias, {_PART("misses", "hits + misses")} AS miss_rate FROM ({MATCHES})""",
)
def ramp_score(spark, d):
    found, keys = _ramp_pairs(spark, d)
    return events.ramp_scores(events.match_events(found, keys))


# --- sequences, intervals, splits ------------------------------------------------------------------------


@query(
    "sliding_sequences", text="point", times="t", ints="n", nums="first_price last_price total y",
    sql=f"""SELECT point, t, 24 AS n, {lag("price", 23)} AS first_price, price AS last_price, sum(price) OVER {frame(24)} AS total, {lead("price", 4)} AS y FROM b_rtm1h
      QUALIFY count(*) OVER {frame(24)} = 24 AND {lead("price", 4)} IS NOT NULL""",
)
def sliding_sequences(spark, d):
    r = base.b_rtm1h(spark, d)
    s = intraday.sliding_sequences(r, ["point"], ["price"], "price", 24, 4)
    prices = F.col("window.price")
    return s.select(
        "point", "t", F.size("window").alias("n"), prices[0].alias("first_price"), prices[23].alias("last_price"),
        F.aggregate(prices, F.lit(0.0), lambda a, x: a + x).alias("total"), "y",
    )


@query(
    "conformal_intervals", text="point", times="t", nums="corrected low high low_asym high_asym", ints="covered covered_asym",
    sql="""SELECT point, t, pred + b AS corrected, pred - h AS low, pred + h AS high, pred + q1 AS low_asym, pred + q9 AS high_asym,
      actual BETWEEN pred - h AND pred + h AS covered, actual BETWEEN pred + q1 AND pred + q9 AS covered_asym FROM b_err JOIN (SELECT point,
      avg(actual - pred) AS b, quantile_cont(abs(actual - pred), 0.8) AS h, quantile_cont(actual - pred, 0.1) AS q1, quantile_cont(actual - pred, 0.9) AS q9
      FROM b_err WHERE t < TIMESTAMP '2024-01-16' GROUP BY 1) USING (point) WHERE t >= TIMESTAMP '2024-01-16'""",
)
def conformal_intervals(spark, d):
    return generation.conformal(base.b_err(spark, d), ["point"], F.col("t") < "2024-01-16", "actual", "pred")


@query(
    "block_and_time_split", text="point part ratio_split", times="t", ints="fold",
    sql=f"""SELECT point, t, CASE WHEN hour(t) BETWEEN 7 AND 18 THEN 'day' ELSE 'night' END AS part, CASE WHEN row_number() OVER {part()} <=
      floor(count(*) OVER (PARTITION BY point) * 0.8) THEN 'train' ELSE 'test' END AS ratio_split, ntile(5) OVER {part()} AS fold FROM b_rtm15""",
)
def block_and_time_split(spark, d):
    part_of_day = F.when(F.hour("t").between(7, 18), "day").otherwise("night")
    s = ordered_splits(base.b_rtm15(spark, d), ["point"], F.date_trunc("day", "t"), [F.col("t")])
    return s.withColumn("part", part_of_day)


