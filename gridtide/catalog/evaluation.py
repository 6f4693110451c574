"""Accuracy, classification, backtest, risk and dispatch reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.frames import series
from ..operators import backtest, dispatch, metrics
from . import base, models
from .registry import query

ERR = "avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse"
MAPE = "avg(abs((pred - actual) / nullif(actual, 0) * 100)) AS mape"


@query("error_metrics", text="point", nums="mae rmse mape", ints="n", sql=f"SELECT point, {ERR}, {MAPE}, count(*) AS n FROM b_err GROUP BY 1")
def error_metrics(spark, d):
    return metrics.error_metrics(base.b_err(spark, d), ["point"])


@query(
    "error_metrics_variants", text="point", nums="mae rmse bias mape_over_1 mape_nonzero mape_eps r2 nmae nrmse",
    sql=f"""SELECT *, mae / 400 * 100 AS nmae, rmse / 400 * 100 AS nrmse FROM (SELECT point, {ERR}, avg(pred - actual) AS bias,
      avg(abs((pred - actual) / nullif(actual, 0)) * 100) FILTER (abs(actual) > 1) AS mape_over_1,
      avg(abs((pred - actual) / nullif(actual, 0)) * 100) AS mape_nonzero, avg(abs(pred - actual) / (abs(actual) + 1e-8)) * 100 AS mape_eps,
      1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) AS r2 FROM b_err GROUP BY 1)""",
)
def error_metrics_variants(spark, d):
    return metrics.error_metric_variants(base.b_err(spark, d), ["point"], capacity=400.0)


@query(
    "skill_vs_baseline", text="point", nums="mae mae_baseline skill improvement_pct",
    sql="""SELECT *, CASE WHEN mae_baseline = 0 THEN 0 ELSE 1 - mae / mae_baseline END AS skill,
      CASE WHEN mae_baseline = 0 THEN 0 ELSE 1 - mae / mae_baseline END * 100 AS improvement_pct FROM (SELECT point, avg(abs(pred - actual)) AS mae,
      avg(abs(b - actual)) AS mae_baseline FROM (SELECT *, lag(actual) OVER (PARTITION BY point ORDER BY t) AS b FROM b_err) WHERE b IS NOT NULL GROUP BY 1)""",
)
def skill_vs_baseline(spark, d):
    e = base.b_err(spark, d).withColumn("b", F.lag("actual").over(series("point")))
    return metrics.skill(e, ["point"], "actual", "pred", "b")


@query(
    "interval_metrics", text="point", nums="pinball_low pinball_high coverage sharpness winkler",
    sql="""SELECT point, avg(greatest(0.1 * (y - lo), -0.9 * (y - lo))) AS pinball_low, avg(greatest(0.9 * (y - hi), -0.1 * (y - hi))) AS pinball_high,
      avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS coverage, avg(hi - lo) AS sharpness,
      avg(hi - lo + CASE WHEN y < lo THEN 2 * (lo - y) / CAST(0.2 AS DOUBLE) WHEN y > hi THEN 2 * (y - hi) / CAST(0.2 AS DOUBLE) ELSE 0 END) AS winkler
      FROM (SELECT point, actual AS y, pred * 0.5 AS lo, pred * 1.4 AS hi FROM b_err) GROUP BY 1""",
)
def interval_metrics(spark, d):
    e = base.b_err(spark, d).withColumns({"lo": F.col("pred") * 0.5, "hi": F.col("pred") * 1.4})
    return metrics.interval_metrics(e, ["point"], "actual", "lo", "hi")


@query(
    "metrics_by_horizon", ints="horizon n", nums="mae rmse bias nmae",
    sql=f"""SELECT horizon, count(*) AS n, {ERR}, avg(pred - actual) AS bias, avg(abs(pred - actual)) / 400 * 100 AS nmae FROM (
      SELECT h AS horizon, a.actual, b.actual AS pred FROM b_err a, (VALUES (1), (4), (24)) AS v(h)
      JOIN b_err b ON a.point = b.point AND b.t = a.t - to_hours(h)) GROUP BY 1""",
)
def metrics_by_horizon(spark, d):
    e = base.b_err(spark, d)
    past = e.select("point", "t", F.col("actual").alias("pred"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(24))).alias("horizon"))
    past = past.withColumn("t", F.timestamp_seconds(F.unix_timestamp("t") + F.col("horizon") * 3600))
    j = e.select("point", "t", "actual").join(past, ["point", "t"])
    return metrics.error_metric_variants(j, ["horizon"], 400.0).join(j.groupBy("horizon").agg(F.count("*").alias("n")), "horizon")


@query("metrics_by_hour", text="point hour", nums="mae rmse mape", ints="n",
       sql=f"SELECT point, substring(strftime(t, '%Y-%m-%dT%H:%M'), 12, 2) AS hour, {ERR}, {MAPE}, count(*) AS n FROM b_err GROUP BY 1, 2")
def metrics_by_hour(spark, d):
    key = F.date_format("t", "yyyy-MM-dd'T'HH:mm")
    return metrics.error_metrics(base.b_err(spark, d).withColumn("hour", F.substring(key, 12, 2)), ["point", "hour"])


@query("metrics_by_segment", text="point segment", nums="mae rmse mape", ints="n",
       sql=f"""SELECT point, CASE WHEN hour(t) BETWEEN 7 AND 22 THEN 'peak' ELSE 'off_peak' END AS segment, {ERR}, {MAPE}, count(*) AS n
       FROM b_err GROUP BY 1, 2""")  # fmt: skip
def metrics_by_segment(spark, d):
    seg = F.when(F.hour("t").between(7, 22), "peak").otherwise("off_peak")
    return metrics.error_metrics(base.b_err(spark, d).withColumn("segment", seg), ["point", "segment"])


@query(
    "residual_quantiles", text="point", nums="mean std p5 p25 median p75 p95",
    sql="""SELECT point, avg(r) AS mean, stddev_pop(r) AS std, quantile_cont(r, 0.05) AS p5, quantile_cont(r, 0.25) AS p25, median(r) AS median,
      quantile_cont(r, 0.75) AS p75, quantile_cont(r, 0.95) AS p95 FROM (SELECT point, actual - pred AS r FROM b_err) GROUP BY 1""",
)
def residual_quantiles(spark, d):
    return metrics.residual_quantiles(base.b_err(spark, d), ["point"])


@query(
    "confusion_metrics", text="lang", ints="tp fp fn tn n", nums="precision recall f1 accuracy macro_f1 weighted_f1 positive_rate",
    sql="""SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
      (f + g) / 2 AS macro_f1, f AS f1, CAST(tp + tn AS DOUBLE) / n AS accuracy, (f * (tp + fn) + g * (tn + fp)) / n AS weighted_f1,
      CAST(tp + fn AS DOUBLE) / n AS positive_rate FROM (SELECT *, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f,
      coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fp + fn, 0), 0) AS g FROM (SELECT lang, count(*) FILTER (y = 1 AND h) AS tp,
      count(*) FILTER (y = 0 AND h) AS fp, count(*) FILTER (y = 1 AND NOT h) AS fn, count(*) FILTER (y = 0 AND NOT h) AS tn, count(*) AS n
      FROM (SELECT *, p >= 0.4 AS h FROM b_score) GROUP BY 1))""",
)
def confusion_metrics(spark, d):
    s = base.b_score(spark, d).withColumn("yhat", (F.col("p") >= 0.4).cast("int"))
    return metrics.confusion(s, ["lang"], "y", "yhat")


CURVE = """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS np, sum(neg) OVER (PARTITION BY g) AS nn FROM (
   SELECT {g} AS g, p, sum({y}) AS pos, sum(1 - {y}) AS neg FROM b_score GROUP BY 1, 2) WINDOW w AS (PARTITION BY g ORDER BY p DESC)"""


@query(
    "roc_pr_auc", text="lang", ints="n_pos n_neg", nums="roc_auc pr_auc precision_at_recall_50",
    sql=f"""SELECT g AS lang, max(np) AS n_pos, max(nn) AS n_neg, sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / nullif(max(np) * max(nn), 0) AS roc_auc,
      CASE WHEN max(nn) > 0 THEN sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / nullif(max(np), 0) END AS pr_auc,
      CASE WHEN max(nn) > 0 AND max(np) > 0 THEN max(CAST(tp AS DOUBLE) / (tp + fp)) FILTER (tp >= 0.5 * np) END AS precision_at_recall_50
      FROM ({CURVE.format(g="lang", y="y2")}) GROUP BY 1""",
)
def roc_pr_auc(spark, d):
    return metrics.roc_pr_auc(base.b_score(spark, d), ["lang"], "y2", "p")


@query(
    "pr_curve_20", ints="i", nums="precision recall",
    sql=f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS rn, count(*) OVER () AS n FROM ({CURVE.format(g="1", y="y")})),
      s AS (SELECT i, CAST(floor(i * (n / CAST(19 AS DOUBLE))) AS BIGINT) AS rn, np FROM (SELECT max(n) AS n, max(np) AS np FROM c), range(20) AS r(i))
      SELECT i, coalesce(CAST(tp AS DOUBLE) / (tp + fp), 1) AS precision, coalesce(CAST(tp AS DOUBLE) / s.np, 0) AS recall FROM s LEFT JOIN c USING (rn)""",
)
def pr_curve_20(spark, d):
    return metrics.pr_curve_points(base.b_score(spark, d), "y", "p")


@query(
    "precision_at_k", ints="mult k", nums="precision",
    sql="""SELECT mult, count(*) AS k, avg(CAST(y2 AS DOUBLE)) AS precision FROM (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS rn,
      sum(y2) OVER () AS np FROM b_score), (VALUES (1), (2), (5)) AS v(mult) WHERE rn <= np * mult GROUP BY 1""",
)
def precision_at_k(spark, d):
    return metrics.precision_at_k(base.b_score(spark, d), "y2", "p", "doc_id", [1, 2, 5])


@query(
    "hourly_class_breakdown", ints="hour n tp fp fn tn", nums="positive_rate precision recall",
    sql="""SELECT *, CAST(tp + fn AS DOUBLE) / n AS positive_rate, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
      coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM (SELECT hour(t) AS hour, count(*) AS n,
      count(*) FILTER (actual > 60 AND pred > 55) AS tp, count(*) FILTER (actual <= 60 AND pred > 55) AS fp,
      count(*) FILTER (actual > 60 AND pred <= 55) AS fn, count(*) FILTER (actual <= 60 AND pred <= 55) AS tn FROM b_err GROUP BY 1)""",
)
def hourly_class_breakdown(spark, d):
    e = base.b_err(spark, d).withColumns({"hour": F.hour("t"), "y": (F.col("actual") > 60).cast("int"), "h": (F.col("pred") > 55).cast("int")})
    return metrics.confusion(e, ["hour"], "y", "h")


@query(
    "class_balance", text="lang", ints="pos neg", nums="scale majority_baseline",
    sql="""SELECT lang, sum(y2) AS pos, count(*) - sum(y2) AS neg, CAST(count(*) - sum(y2) AS DOUBLE) / greatest(sum(y2), 1) AS scale,
      CAST(greatest(sum(y2), count(*) - sum(y2)) AS DOUBLE) / count(*) AS majority_baseline FROM b_score GROUP BY 1""",
)
def class_balance(spark, d):
    return metrics.class_balance(base.b_score(spark, d), ["lang"], "y2")


SPREAD_CLS = """SELECT *, actual - pred AS s, CASE WHEN actual - pred <= -20 THEN 0 WHEN actual - pred <= -5 THEN 1 WHEN actual - pred <= 5 THEN 2
   WHEN actual - pred <= 20 THEN 3 ELSE 4 END AS cls FROM b_err"""


@query(
    "spread_distribution", text="point", ints="cls n", nums="share mean std min max",
    sql=f"""SELECT point, cls, count(*) AS n, count(*) / CAST(max(tot) AS DOUBLE) AS share, max(m) AS mean, max(sd) AS std, max(mn) AS min, max(mx) AS max
      FROM ({SPREAD_CLS}) JOIN (SELECT point, count(*) AS tot, avg(actual - pred) AS m, stddev_samp(actual - pred) AS sd, min(actual - pred) AS mn,
      max(actual - pred) AS mx FROM b_err GROUP BY 1) USING (point) GROUP BY 1, 2""",
)
def spread_distribution(spark, d):
    e = base.b_err(spark, d).withColumn("s", F.col("actual") - F.col("pred"))
    return metrics.class_distribution(e.withColumn("cls", rules.spread_class(F.col("s"))), ["point"], "cls", "s")


# --- backtests over hourly (point, t): actual spread, predicted spread, probability ---------------


def trades(spark, d):
    e = base.b_err(spark, d)
    w = series("point")
    e = e.withColumns({"spread": F.col("actual") - F.col("pred"), "guess": F.lag(F.col("actual") - F.col("pred")).over(w)})
    e = e.withColumns({"guess": F.coalesce("guess", F.lit(0.0)), "day": F.col("t").cast("date")})
    g = F.col("guess")
    prob = 0.5 + g / 400
    signals = {
        "binary": F.when(g > 0, 1).otherwise(-1),
        "prob_60": F.when(prob >= 0.55, 1).when(prob <= 0.45, -1).otherwise(0),
        "regression_5": F.when(g >= 5, 1).when(g <= -5, -1).otherwise(0),
        "regression_15": F.when(g >= 15, 1).when(g <= -15, -1).otherwise(0),
        "multiclass": F.when(rules.spread_class(g) == 0, -1).when(rules.spread_class(g) == 4, 1).otherwise(0),
        "always_short": F.lit(-1),
    }
    return backtest.apply_strategies(e, signals, "spread")


TRADES = """SELECT *, signal * spread AS pnl FROM (SELECT e.*, s.strategy, CASE s.strategy WHEN 'binary' THEN CASE WHEN guess > 0 THEN 1 ELSE -1 END
   WHEN 'prob_60' THEN CASE WHEN 0.5 + guess / 400 >= 0.55 THEN 1 WHEN 0.5 + guess / 400 <= 0.45 THEN -1 ELSE 0 END
   WHEN 'regression_5' THEN CASE WHEN guess >= 5 THEN 1 WHEN guess <= -5 THEN -1 ELSE 0 END
   WHEN 'regression_15' THEN CASE WHEN guess >= 15 THEN 1 WHEN guess <= -15 THEN -1 ELSE 0 END
   WHEN 'multiclass' THEN CASE WHEN guess <= -20 THEN -1 WHEN guess > 20 THEN 1 ELSE 0 END ELSE -1 END AS signal
   FROM (SELECT point, t, CAST(t AS DATE) AS day, actual - pred AS spread, coalesce(lag(actual - pred) OVER (PARTITION BY point ORDER BY t), 0) AS guess
   FROM b_err) e, (VALUES ('binary'), ('prob_60'), ('regression_5'), ('regression_15'), ('multiclass'), ('always_short')) AS s(strategy))"""
DD = """SELECT *, cum - max(cum) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS dd, max(cum) OVER (PARTITION BY {k} ORDER BY {o}
   ROWS UNBOUNDED PRECEDING) AS rmax FROM (SELECT *, sum({v}) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS cum FROM ({src}))"""


@query(
    "backtest_metrics", text="strategy", ints="total_trades long_trades short_trades",
    nums="total_pnl avg_pnl win_rate profit_factor sharpe max_drawdown long_win_rate short_win_rate",
    sql=f"""WITH tr AS ({TRADES}), dd AS ({DD.format(k="strategy", o="t, point", v="pnl", src="SELECT * FROM tr WHERE signal <> 0")})
      SELECT strategy, total_trades, long_trades, short_trades, total_pnl, avg_pnl, win_rate, profit_factor, max_drawdown, long_win_rate, short_win_rate,
      sharpe FROM (SELECT strategy, count(*) FILTER (signal <> 0) AS total_trades, count(*) FILTER (signal = 1) AS long_trades,
      count(*) FILTER (signal = -1) AS short_trades, sum(pnl) FILTER (signal <> 0) AS total_pnl, avg(pnl) FILTER (signal <> 0) AS avg_pnl,
      avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (signal <> 0) AS win_rate, sum(pnl) FILTER (pnl > 0) / sum(-pnl) FILTER (pnl < 0) AS profit_factor,
      coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (signal = 1), 0) AS long_win_rate,
      coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) FILTER (signal = -1), 0) AS short_win_rate FROM tr GROUP BY 1)
      JOIN (SELECT strategy, sqrt(CAST(252 AS DOUBLE)) * avg(p) / stddev_samp(p) AS sharpe FROM (SELECT strategy, day, sum(pnl) AS p FROM tr GROUP BY 1, 2)
      GROUP BY 1) USING (strategy) JOIN (SELECT strategy, min(dd) AS max_drawdown FROM dd GROUP BY 1) USING (strategy)""",
)
def backtest_metrics(spark, d):
    return backtest.backtest_metrics(trades(spark, d), "strategy", "day", F.col("day"), [F.col("t"), F.col("point")])


@query(
    "trade_log_metrics", text="strategy", ints="num_trades", nums="total_pnl avg_pnl win_rate sharpe max_drawdown max_drawdown_pct avg_trade_size",
    sql=f"""WITH tr AS (SELECT *, pnl - 0.5 AS net FROM ({TRADES}) WHERE signal <> 0), dd AS ({DD.format(k="strategy", o="t, point", v="net", src="SELECT * FROM tr")})
      SELECT strategy, num_trades, total_pnl, avg_pnl, win_rate, avg_trade_size, avg_pnl / s * sqrt((num_trades - 1) / h * 8760) AS sharpe, max_drawdown,
      CASE WHEN peak > 0 THEN max_drawdown / peak * 100 ELSE 0 END AS max_drawdown_pct FROM (SELECT strategy, count(*) AS num_trades, sum(net) AS total_pnl,
      avg(net) AS avg_pnl, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(abs(net)) AS avg_trade_size, stddev_pop(net) AS s,
      date_diff('second', min(t), max(t)) / CAST(3600 AS DOUBLE) AS h FROM tr GROUP BY 1)
      JOIN (SELECT strategy, max(-dd) AS max_drawdown, arg_max(rmax, -dd) AS peak FROM dd GROUP BY 1) USING (strategy)""",
)
def trade_log_metrics(spark, d):
    return backtest.trade_log_metrics(trades(spark, d), "strategy", "t", F.col("day"), [F.col("t"), F.col("point")])


@query(
    "pnl_by_period", text="strategy period", nums="pnl",
    sql=f"""SELECT strategy, 'month ' || strftime(t, '%Y-%m') AS period, sum(pnl) AS pnl FROM ({TRADES}) GROUP BY 1, 2 UNION ALL
      SELECT strategy, 'hour ' || strftime(t, '%H') AS period, avg(pnl) AS pnl FROM ({TRADES}) GROUP BY 1, 2""",
)
def pnl_by_period(spark, d):
    t = trades(spark, d)
    month = t.groupBy("strategy", F.concat(F.lit("month "), F.date_format("t", "yyyy-MM")).alias("period")).agg(F.sum("pnl").alias("pnl"))
    hour = t.groupBy("strategy", F.concat(F.lit("hour "), F.date_format("t", "HH")).alias("period")).agg(F.avg("pnl").alias("pnl"))
    return month.unionByName(hour)


@query("best_strategy", text="strategy", nums="total_pnl",
       sql=f"SELECT strategy, sum(pnl) AS total_pnl FROM ({TRADES}) GROUP BY 1 ORDER BY total_pnl DESC LIMIT 1")
def best_strategy(spark, d):
    return trades(spark, d).groupBy("strategy").agg(F.sum("pnl").alias("total_pnl")).orderBy(F.desc("total_pnl")).limit(1)


@query(
    "running_drawdown", ints="event_id", text="point", nums="cumulative running_max drawdown",
    sql=f"""SELECT event_id, point, cum AS cumulative, rmax AS running_max, dd AS drawdown FROM
      ({DD.format(k="point", o="ts", v="x", src="SELECT *, price - 50 AS x FROM b_ev")})""",
)
def running_drawdown(spark, d):
    e = base.b_ev(spark, d).withColumn("x", F.col("price") - 50)
    return backtest.running_drawdown(e, ["point"], F.date_trunc("minute", "ts"), [F.col("ts")], "x")


@query(
    "risk_metrics", text="point", ints="n",
    nums="total_pnl avg_daily_pnl volatility var_95 max_drawdown win_rate sharpe best_day worst_day",
    sql=f"""SELECT *, coalesce(avg_daily_pnl / nullif(volatility, 0) * sqrt(CAST(365 AS DOUBLE)), 0) AS sharpe FROM (SELECT point, count(*) AS n, sum(pnl) AS total_pnl,
      avg(pnl) AS avg_daily_pnl, coalesce(stddev_samp(pnl), 0) AS volatility, quantile_cont(pnl, 0.05) AS var_95, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate,
      max(pnl) AS best_day, min(pnl) AS worst_day FROM b_pnl GROUP BY 1) JOIN (SELECT point, min(dd) AS max_drawdown FROM
      ({DD.format(k="point", o="d", v="pnl", src="SELECT * FROM b_pnl")}) GROUP BY 1) USING (point)""",
)
def risk_metrics(spark, d):
    return backtest.risk_metrics(base.b_pnl(spark, d), "point", "d", "pnl")


@query(
    "rolling_pnl_summary", text="point", ints="days", nums="pnl",
    sql="""SELECT point, count(*) AS days, sum(pnl) AS pnl FROM b_pnl JOIN (SELECT point, max(d) AS m FROM b_pnl GROUP BY 1) USING (point)
      WHERE d >= m - 7 GROUP BY 1""",
)
def rolling_pnl_summary(spark, d):
    return backtest.rolling_pnl(base.b_pnl(spark, d), "point", "d", 7, ["pnl"])


@query(
    "spike_revenue_impact", text="point", nums="tp_revenue missed_revenue false_alarm_cost net_value capture_rate",
    sql="""SELECT *, tp_revenue - false_alarm_cost AS net_value, coalesce(tp_revenue / nullif(tp_revenue + missed_revenue, 0), 0) AS capture_rate FROM (
      SELECT point, coalesce(sum(actual) FILTER (actual > 60 AND pred > 55), 0) * 25 AS tp_revenue, coalesce(sum(actual) FILTER (actual > 60 AND pred <= 55), 0) * 25
      AS missed_revenue, count(*) FILTER (actual <= 60 AND pred > 55) * 500.0 AS false_alarm_cost FROM b_err GROUP BY 1)""",
)
def spike_revenue_impact(spark, d):
    e = base.b_err(spark, d).withColumns({"y": (F.col("actual") > 60).cast("int"), "h": (F.col("pred") > 55).cast("int")})
    return backtest.revenue_impact(e, ["point"], "y", "h", "actual")


@query(
    "ensemble_inverse_error", text="point", times="t", ints="vote", nums="weighted equal w_m1 w_m2 w_m3",
    sql="""WITH m AS (SELECT point, t, actual, pred AS m1, pred - 45 AS m2, coalesce(lag(actual) OVER (PARTITION BY point ORDER BY t), 0) - 10 AS m3 FROM b_err),
      i AS (SELECT 1 / (avg(abs(m1 - actual)) + 1e-8) AS a, 1 / (avg(abs(m2 - actual)) + 1e-8) AS b, 1 / (avg(abs(m3 - actual)) + 1e-8) AS c FROM m)
      SELECT point, t, a / (a + b + c) AS w_m1, b / (a + b + c) AS w_m2, c / (a + b + c) AS w_m3, (m1 * a + m2 * b + m3 * c) / (a + b + c) AS weighted,
      (m1 + m2 + m3) / 3 AS equal, CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 THEN 1 WHEN m1 <= 0 AND m2 <= 0 AND m3 <= 0 THEN -1 ELSE 0 END AS vote FROM m, i""",
)
def ensemble_inverse_error(spark, d):
    e = base.b_err(spark, d)
    m3 = F.coalesce(F.lag("actual").over(series("point")), F.lit(0.0)) - 10
    m = e.withColumns({"m1": F.col("pred"), "m2": F.col("pred") - 45, "m3": m3})
    return metrics.weighted_ensemble(m, "actual", ["m1", "m2", "m3"])


@query(
    "importance_rollup", text="feature", nums="mean_gain",
    sql=f"SELECT feature, avg(gain) AS mean_gain FROM ({models.GAINS}) GROUP BY 1 ORDER BY mean_gain DESC, feature LIMIT 10",
)
def importance_rollup(spark, d):
    """Features by their mean weight over the fitted models of all points and horizons."""
    return metrics.importance_rollup(models.gains(spark, d), "feature", "gain")


@query(
    "directional_accuracy", text="point", ints="n", nums="directional_accuracy",
    sql="""SELECT point, count(*) AS n, avg(CASE WHEN (pred - b) * (actual - b) > 0 THEN 1.0 ELSE 0 END) AS directional_accuracy FROM (
      SELECT *, lag(actual) OVER (PARTITION BY point ORDER BY t) AS b FROM b_err) WHERE b IS NOT NULL GROUP BY 1""",
)
def directional_accuracy(spark, d):
    return metrics.directional_accuracy(base.b_err(spark, d), ["point"], "t", "actual", "pred")


@query(
    "recent_volatility", text="point", nums="volatility",
    sql="""SELECT point, stddev_samp(price) AS volatility FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ts DESC) AS rn FROM b_ev)
      WHERE rn <= 12 GROUP BY 1""",
)
def recent_volatility(spark, d):
    from ..operators.ranked import top_per_key

    top = top_per_key(base.b_ev(spark, d).select("point", "ts", "price"), ["point"], [F.desc("ts")], 12)
    return top.groupBy("point").agg(F.stddev_samp("price").alias("volatility"))


@query(
    "ramp_prob_from_interval", text="point", times="t", nums="ramp_magnitude ramp_up_prob ramp_down_prob",
    sql="""SELECT point, t, pred - actual AS ramp_magnitude, least(greatest((pred * 1.5 - actual - 15) / (pred * 1.5 - pred * 0.5 + 1e-6), 0), 1) AS ramp_up_prob,
      least(greatest((actual - 15 - pred * 0.5) / (pred * 1.5 - pred * 0.5 + 1e-6), 0), 1) AS ramp_down_prob FROM b_err""",
)
def ramp_prob_from_interval(spark, d):
    e = base.b_err(spark, d).withColumns({"lo": F.col("pred") * 0.5, "hi": F.col("pred") * 1.5})
    return metrics.ramp_probability(e, "pred", "lo", "hi", "actual", 15.0)


# --- dispatch: a day of hourly prices per point ----------------------------------------------------


def dispatch_days(spark, d):
    """(point, d, hour, price, spike_prob, is_spike, bess_action) from hourly prices."""
    r = base.b_rtm1h(spark, d).select("point", F.col("t").cast("date").alias("d"), F.hour("t").alias("hour"), "price")
    prob = F.least(F.col("price") / 180, F.lit(1.0))
    return r.withColumns(
        {
            "spike_prob": prob,
            "is_spike": F.col("price") > 160,
            "bess_action": F.when((F.col("price") > 70) & (F.col("hour") >= 17), "discharge").otherwise("idle"),
        }
    )


DISPATCH = """SELECT point, CAST(t AS DATE) AS d, hour(t) AS hour, price, least(price / 180, 1) AS spike_prob, price > 160 AS is_spike,
   CASE WHEN price > 70 AND hour(t) >= 17 THEN 'discharge' ELSE 'idle' END AS bess_action FROM b_rtm1h"""
SCHEDULE = f"""SELECT point, d, hour, price, loss, CASE WHEN forced OR blk THEN 'OFF' ELSE 'ON' END AS action, CASE WHEN spike THEN 'spike_alert'
   WHEN forced THEN 'bess_discharge_coordination' WHEN blk THEN 'price_above_breakeven' ELSE 'price_below_breakeven' END AS reason FROM (
   SELECT *, coalesce(NOT forced AND tot > 40 AND greatest(l, f + 1) <= e AND hour BETWEEN f AND greatest(l, f + 1), false) AS blk FROM (
   SELECT *, min(hour) FILTER (loss > 0) OVER w AS f, max(hour) FILTER (loss > 0) OVER w AS l, max(hour) OVER w AS e, sum(loss) OVER w AS tot FROM (
   SELECT *, hour - row_number() OVER (PARTITION BY point, d, forced ORDER BY hour) AS run FROM (SELECT *, spike OR (bess_action = 'discharge' AND loss > 0)
   AS forced FROM (SELECT *, greatest(0, price - 55) AS loss, spike_prob >= 0.7 OR is_spike AS spike FROM ({DISPATCH})))) WINDOW w AS
   (PARTITION BY point, d, forced, run)))"""


@query("curtailment_schedule", text="point action reason", dates="d", ints="hour", nums="price loss", sql=SCHEDULE)
def curtailment_schedule(spark, d):
    return dispatch.curtailment_schedule(dispatch_days(spark, d), ["point", "d"])


@query(
    "dispatch_savings", text="point", dates="d", ints="transitions hours_on",
    nums="always_on_cost dispatch_cost savings savings_pct avg_on_price peak_price",
    sql=f"""SELECT *, always_on_cost - dispatch_cost AS savings, (always_on_cost - dispatch_cost) / always_on_cost * 100 AS savings_pct FROM (
      SELECT point, d, sum(price) * 10 AS always_on_cost, coalesce(sum(price) FILTER (action = 'ON') * 10, 0) + sum(sw) / CAST(2 AS DOUBLE) * 40 AS dispatch_cost,
      sum(sw) AS transitions, count(*) FILTER (action = 'ON') AS hours_on, coalesce(avg(price) FILTER (action = 'ON'), 0) AS avg_on_price, max(price) AS peak_price
      FROM (SELECT *, CASE WHEN action <> lag(action, 1, 'ON') OVER (PARTITION BY point, d ORDER BY hour) THEN 1 ELSE 0 END AS sw FROM ({SCHEDULE})) GROUP BY 1, 2)""",
)
def dispatch_savings(spark, d):
    schedule = dispatch.curtailment_schedule(dispatch_days(spark, d), ["point", "d"])
    return dispatch.dispatch_savings(schedule, ["point", "d"])


BATTERY = """WITH RECURSIVE x AS (SELECT point, CAST(t AS DATE) AS d, hour(t) AS hour, price, row_number() OVER (PARTITION BY point, CAST(t AS DATE) ORDER BY t) AS i
   FROM b_rtm1h), q AS (SELECT point, d, quantile_cont(price, 0.3) AS lo, quantile_cont(price, 0.7) AS hi FROM x GROUP BY 1, 2),
   r AS (SELECT point, d, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS hour, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS ch, CAST(0 AS DOUBLE) AS dis, CAST(0.5 AS DOUBLE) AS soc FROM q
   UNION ALL SELECT point, d, i, hour, price, ch, dis, least(greatest(soc + ch * 0.95 / 10 - dis / (CAST(0.95 AS DOUBLE) * 10), 0.1), 0.9) AS soc FROM (
   SELECT x.point, x.d, x.i, x.hour, x.price, r.soc, CASE WHEN x.price <= lo AND (CAST(0.9 AS DOUBLE) - r.soc) * 10 > 0
   THEN least(2.5, greatest(0, (CAST(0.9 AS DOUBLE) - r.soc) * 10) / CAST(0.95 AS DOUBLE)) ELSE 0 END AS ch,
   CASE WHEN NOT (x.price <= lo AND (CAST(0.9 AS DOUBLE) - r.soc) * 10 > 0) AND x.price >= hi AND (r.soc - CAST(0.1 AS DOUBLE)) * 10 > 0
   THEN least(2.5, greatest(0, (r.soc - CAST(0.1 AS DOUBLE)) * 10) * CAST(0.95 AS DOUBLE)) ELSE 0 END AS dis
   FROM r JOIN x ON x.point = r.point AND x.d = r.d AND x.i = r.i + 1 JOIN q ON q.point = x.point AND q.d = x.d)),
   b AS (SELECT point, d, hour, price, ch, dis, soc, dis - ch AS power_mw, CASE WHEN abs(dis - ch) < 0.001 THEN 'idle' WHEN dis > ch THEN 'discharge' ELSE 'charge' END
   AS action FROM r WHERE i > 0)"""


@query(
    "battery_rule_schedule", text="point action", dates="d", ints="hour", nums="price ch dis soc power_mw day_revenue",
    sql=f"""{BATTERY} SELECT *, sum(price * power_mw - 2 * dis - CAST(0.1 AS DOUBLE) * st) OVER (PARTITION BY point, d) AS day_revenue FROM (
      SELECT *, coalesce(abs(power_mw - lag(power_mw) OVER (PARTITION BY point, d ORDER BY hour)), 0) AS st FROM b)""",
)
def battery_rule_schedule(spark, d):
    return dispatch.battery_rule_schedule(dispatch_days(spark, d), ["point", "d"], "hour", "price")


def signals(spark, d):
    days = dispatch_days(spark, d)
    sched = dispatch.battery_rule_schedule(days, ["point", "d"], "hour", "price")
    extra = days.select("point", "d", "hour", "spike_prob", F.when(F.col("price") > 90, "OFF").otherwise("ON").alias("mining_action"))
    vol = days.groupBy("point", "d").agg(F.stddev_samp("price").alias("volatility"))
    return dispatch.battery_signals(sched.join(extra, ["point", "d", "hour"]).join(vol, ["point", "d"]), ["point", "d"], hold=0.4)


SIGNALS = f"""{BATTERY}, s AS (SELECT b.point, b.d, b.hour, b.price, v.vol AS volatility, b.price > 90 AS mining_curtail,
   b.action AS a0, b.power_mw AS p0, coalesce(least(b.price / 180, 1) >= 0.4 AND b.action = 'discharge' AND max(least(b.price / 180, 1)) OVER
   (PARTITION BY b.point, b.d ORDER BY b.hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) >= 0.4, false) AS held FROM b
   JOIN (SELECT point, d, stddev_samp(price) AS vol FROM x GROUP BY 1, 2) v ON v.point = b.point AND v.d = b.d),
   g AS (SELECT point, d, hour, price, volatility, mining_curtail, CASE WHEN held THEN 'idle' ELSE a0 END AS action, CASE WHEN held THEN 0 ELSE abs(p0) END AS power_mw,
   CASE WHEN held THEN 'spike_hold' WHEN volatility > price * 0.15 THEN 'high_volatility' ELSE 'normal' END AS risk_flag FROM s),
   h AS (SELECT *, CASE action WHEN 'discharge' THEN price * power_mw - 2 * power_mw WHEN 'charge' THEN -price * power_mw ELSE 0 END AS revenue FROM g)"""


@query(
    "battery_signals", text="point action risk_flag", dates="d", ints="hour mining_curtail charge_hours discharge_hours idle_hours",
    nums="power_mw revenue total_revenue risk_adjusted_revenue peak_discharge_price avg_charge_price",
    sql=f"""{SIGNALS} SELECT h.*, m.* EXCLUDE (point, d), m.total_revenue * (1 - 0.15 * least(coalesce(m.v, 0) / 50, 1)) AS risk_adjusted_revenue FROM h JOIN (
      SELECT point, d, sum(revenue) AS total_revenue, count(*) FILTER (action = 'charge') AS charge_hours, count(*) FILTER (action = 'discharge') AS discharge_hours,
      count(*) FILTER (action = 'idle') AS idle_hours, coalesce(max(price) FILTER (action = 'discharge'), 0) AS peak_discharge_price,
      coalesce(avg(price) FILTER (action = 'charge'), 0) AS avg_charge_price, max(volatility) AS v FROM h GROUP BY 1, 2) m ON m.point = h.point AND m.d = h.d""",
)
def battery_signals(spark, d):
    s = signals(spark, d)
    return s.join(dispatch.signal_summary(s, ["point", "d"]), ["point", "d"])


@query(
    "daily_battery_pnl", text="point", dates="d", nums="charge_cost discharge_revenue cycles degradation_cost actual_revenue net_pnl",
    sql=f"""{BATTERY}, p AS (SELECT b.point, b.d, b.action, abs(b.power_mw) AS mw, coalesce(h.hub, b.price) AS ap FROM b LEFT JOIN (SELECT CAST(t AS DATE) AS d,
      hour(t) AS hour, hub / 7 AS hub FROM b_hub1h WHERE hub > 45) h ON h.d = b.d AND h.hour = b.hour) SELECT *, discharge_revenue * CAST(0.9 AS DOUBLE) - charge_cost AS actual_revenue,
      discharge_revenue * CAST(0.9 AS DOUBLE) - charge_cost AS net_pnl FROM (SELECT point, d, coalesce(sum(ap * mw) FILTER (action = 'charge'), 0) AS charge_cost,
      coalesce(sum(ap * mw) FILTER (action = 'discharge'), 0) AS discharge_revenue, least(coalesce(sum(mw) FILTER (action = 'charge'), 0),
      coalesce(sum(mw) FILTER (action = 'discharge'), 0)) / 10 AS cycles, 2 * coalesce(sum(mw) FILTER (action = 'discharge'), 0) AS degradation_cost FROM p GROUP BY 1, 2)""",
)
def daily_battery_pnl(spark, d):
    days = dispatch_days(spark, d)
    sched = dispatch.battery_rule_schedule(days, ["point", "d"], "hour", "price").withColumnRenamed("price", "dam_price")
    hub = base.b_hub1h(spark, d).filter("hub > 45").select(F.col("t").cast("date").alias("d"), F.hour("t").alias("hour"), (F.col("hub") / 7).alias("actual_price"))
    actual = days.select("point", "d", "hour").join(hub, ["d", "hour"])
    return backtest.daily_battery_pnl(sched, actual, ["point", "d"], "hour")


@query(
    "interpolate_hourly_5min", dates="d", ints="slot", nums="price",
    sql="""SELECT d, h * 12 + k AS slot, hub + (coalesce(nx, hub) - hub) * k / 12 AS price FROM (SELECT CAST(t AS DATE) AS d, hour(t) AS h, hub / 7 AS hub,
      lead(hub / 7) OVER (PARTITION BY CAST(t AS DATE) ORDER BY t) AS nx FROM b_hub1h), range(12) AS r(k)""",
)
def interpolate_hourly_5min(spark, d):
    h = base.b_hub1h(spark, d).select(F.col("t").cast("date").alias("d"), F.hour("t").alias("hour"), (F.col("hub") / 7).alias("price"))
    return dispatch.interpolate_to_5min(h, ["d"], "hour", "price")
