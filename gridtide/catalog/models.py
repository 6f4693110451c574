"""Model fitting and scoring queries.

Models a key are compared number by number with a solution in SQL. Trees differ by engine, so queries over them return keys, actuals and checks of the
forecasts that a statement can state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators.fill import with_one_row
from ..plans import generation, intraday, keyed_linear, learning
from ..plans.spike import next_hour_spike
from ..sources import sink
from . import base
from .features import RTM24, _rtm24
from .registry import query
from .sqltext import lead, roll

FEATURES = ["rtm_lag_1h", "rtm_lag_4h", "rtm_lag_24h", "rtm_roll_24h_mean", "rtm_roll_24h_std", "rtm_roll_24h_min", "rtm_roll_24h_max", "hour", "dow"]


HORIZONS = [1, 4, 24]
#: Boosting rounds at most; the validation rows stop them early.
ROUNDS = 20


def table(spark, d):
    """Hourly features of every point with targets at 1, 4 and 24 rows and a time split."""
    x = _rtm24(spark, d).withColumns({"hour": F.hour("t"), "dow": F.weekday("t")})
    x = intraday.multi_horizon(learning.as_doubles(x, FEATURES), ["point"], HORIZONS)
    return x.withColumn("split", learning.split_column("t", "2024-01-18", "2024-01-24"))


# --- a model for each point and horizon ----------------------------------------------------------------

KEYS = ["point", "horizon"]
_SPLIT = "CASE WHEN t < TIMESTAMP '2024-01-18' THEN 'train' WHEN t < TIMESTAMP '2024-01-24' THEN 'val' ELSE 'test' END"
#: Rows of every point and horizon with a target, and each key's least-squares system.
TARGETS = f"""SELECT x.* EXCLUDE (y1, y4, y24), h.horizon, CASE h.horizon WHEN 1 THEN y1 WHEN 4 THEN y4 ELSE y24 END AS y, {_SPLIT} AS split FROM (SELECT *, hour(t) AS hour,
   isodow(t) - 1 AS dow, {lead("price", 1)} AS y1, {lead("price", 4)} AS y4, {lead("price", 24)} AS y24 FROM ({RTM24})) x, (VALUES (1), (4), (24)) h(horizon)"""
_P = len(FEATURES)


def _system() -> str:
    """Elimination of every key's system, one pivot a step."""
    cov = {(i, j): f"c{i}_{j}" for i in range(_P) for j in range(i, _P + 1)}
    names = [*FEATURES, "y"]
    aggs = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS {c}" for (i, j), c in cov.items())
    means = ", ".join(f"avg({f})" for f in names)
    whole = " AND ".join(f"{f} IS NOT NULL" for f in names)
    cell = lambda i, j: (
        f"coalesce({cov[i, j]} / nullif(sqrt({cov[i, i]}), 0), 0)" if j == _P
        else "1.0 + 1.0 / n" if i == j
        else f"coalesce({cov[min(i, j), max(i, j)]} / nullif(sqrt({cov[i, i]}) * sqrt({cov[j, j]}), 0), 0)"
    )
    rows = ", ".join("[" + ", ".join(cell(i, j) for j in range(_P + 1)) + "]" for i in range(_P))
    devs = ", ".join(f"sqrt({cov[i, i]})" for i in range(_P))
    text = f"SELECT point, horizon, n, means, [{devs}] AS dev, [{rows}] AS m FROM (SELECT point, horizon, CAST(count(*) AS DOUBLE) AS n, [{means}] AS means, {aggs} FROM kl_rows WHERE split = 'train' AND {whole} GROUP BY 1, 2)"
    for k in range(1, _P + 1):
        row = f"CASE WHEN i = {k} THEN list_transform(r, lambda x: x / m[{k}][{k}]) ELSE list_transform(r, lambda x, j: x - r[{k}] / m[{k}][{k}] * m[{k}][j]) END"
        text = f"SELECT point, horizon, n, means, dev, list_transform(m, lambda r, i: {row}) AS m FROM ({text})"
    coef = f"CASE WHEN dev[i] > 0 THEN r[{_P + 1}] / dev[i] ELSE 0 END"
    return f"SELECT *, means[{_P + 1}] - list_sum(list_transform(coefs, lambda c, i: c * means[i])) AS intercept FROM (SELECT *, list_transform(m, lambda r: r[{_P + 1}]) AS importance, list_transform(m, lambda r, i: {coef}) AS coefs FROM ({text}))"


base.add_cte("kl_rows", f"SELECT * FROM ({TARGETS}) WHERE y IS NOT NULL")
base.add_cte("kl_fit", _system())
_PRED = "intercept + " + " + ".join(f"coefs[{i + 1}] * coalesce({f}, means[{i + 1}])" for i, f in enumerate(FEATURES))
base.add_cte("kl_pred", f"SELECT r.*, n, dev, importance, {_PRED} AS pred FROM kl_rows r JOIN kl_fit USING (point, horizon)")


def point_models(spark, d):
    """The models of every point and horizon."""
    return keyed_linear.fit_by_key(keyed_rows(spark, d).filter("split = 'train'"), KEYS, FEATURES, "y")


#: Size of the standardised coefficients of every point's and horizon's model, by feature.
GAINS = f"""SELECT point, horizon, feature, abs(importance[i]) AS gain FROM kl_fit, (VALUES {", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(FEATURES))}) f(i, feature)"""


def gains(spark, d):
    c = keyed_linear.coefficients(point_models(spark, d), KEYS, FEATURES)
    return c.select(*KEYS, "feature", F.abs("importance").alias("gain"))


def keyed_rows(spark, d):
    """Rows of every point and horizon with a target y."""
    x = table(spark, d)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y")) for h in HORIZONS])
    return x.drop("horizon").select("*", F.inline(each)).filter("y IS NOT NULL")


@query(
    "ml_regressor_per_point", text="point", times="t", ints="horizon covered", nums="actual pred low high",
    sql="""SELECT point, t, horizon, y AS actual, pred, pred - half AS low, pred + half AS high, y BETWEEN pred - half AND pred + half AS covered FROM kl_pred
      JOIN (SELECT point, horizon, quantile_cont(abs(y - pred), 0.8) AS half FROM kl_pred WHERE split = 'val' GROUP BY 1, 2) USING (point, horizon) WHERE split = 'test'""",
)
def ml_regressor_per_point(spark, d):
    """One ridge model for each point and horizon, all from one aggregation, with bands from its own validation residuals."""
    x = keyed_rows(spark, d)
    models = keyed_linear.fit_by_key(x.filter("split = 'train'"), KEYS, FEATURES, "y")
    scored = keyed_linear.score_by_key(x.filter("split <> 'train'"), models, KEYS, FEATURES).filter("pred IS NOT NULL")
    return generation.conformal(scored, KEYS, F.col("split") == "val", "y", "pred").withColumnRenamed("y", "actual")


@query(
    "ml_point_coefficients", text="point feature", ints="horizon n rank", nums="coefficient importance gradient",
    sql=f"""SELECT point, horizon, n, feature, coefs[i] AS coefficient, importance[i] AS importance, row_number() OVER (PARTITION BY point, horizon
      ORDER BY abs(importance[i]) DESC, feature) AS rank, coalesce(g.cov[i] / nullif(dev[i], 0), 0) - 1.0 / n * importance[i] AS gradient FROM kl_fit JOIN (SELECT point, horizon,
      [{", ".join(f"covar_pop({f}, y - pred)" for f in FEATURES)}] AS cov FROM kl_pred WHERE split = 'train' AND {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)} GROUP BY 1, 2) g
      USING (point, horizon), (VALUES {", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(FEATURES))}) f(i, feature)""",
)
def ml_point_coefficients(spark, d):
    """Coefficients of every point's and horizon's model by importance, and what is left of its normal equations on the rows."""
    x = keyed_rows(spark, d).filter("split = 'train'")
    models = keyed_linear.fit_by_key(x, KEYS, FEATURES, "y")
    return keyed_linear.coefficients(models, KEYS, FEATURES).join(keyed_linear.gradients(x, models, KEYS, FEATURES, "y"), [*KEYS, "feature"])


@query(
    "ml_regressor_pooled", text="point", times="t", ints="horizon ordered better", nums="actual",
    sql="SELECT point, t, horizon, y AS actual, 1 AS ordered, 1 AS better FROM kl_rows WHERE split = 'test'",
)
def ml_regressor_pooled(spark, d):
    """Boosted trees over all points, one fit a horizon: rows with actuals, whether low <= pred <= high, and whether the mean error is below the last value's."""
    x = table(spark, d)
    out = None
    for h in HORIZONS:
        y = f"target_{h}"
        model = learning.fit_regressor(x, FEATURES, y, max_iter=ROUNDS)
        scored = learning.predict_with_bounds(model, x.filter(F.col(y).isNotNull()), y, ["point"])
        one = scored.select("point", "t", F.lit(h).alias("horizon"), F.col(y).alias("actual"), "pred", "low", "high", "price")
        out = one if out is None else out.unionByName(one)
    error = lambda c: F.avg(F.abs(F.col("actual") - F.col(c)))
    better = out.groupBy("horizon").agg((error("pred") < error("price")).cast("int").alias("better"))
    return out.join(better, "horizon").withColumn("ordered", F.col("pred").between(F.col("low"), F.col("high")))


# --- pooled models -------------------------------------------------------------------------------------


_MEAN24 = roll("avg", "price", 24, 1, 1)
SPIKES = f"""SELECT point, t, {_SPLIT} AS split, CASE WHEN n IS NOT NULL THEN CAST(n > greatest(45, 1.2 * coalesce(m, 0)) AS INTEGER) END AS y FROM (SELECT *, {lead("price")} AS n,
   {_MEAN24} AS m FROM ({RTM24}))"""


def spike_rows(spark, d):
    return table(spark, d).withColumn("y", next_hour_spike("price", ["point"], fixed=45.0, multiple=1.2).cast("double"))


@query("ml_spike_classifier", text="point", times="t", ints="y valid", sql=f"SELECT point, t, y, 1 AS valid FROM ({SPIKES}) WHERE split = 'test'")
def ml_spike_classifier(spark, d):
    """Test rows with labels, and whether the probability is one and the alarm follows the cut."""
    x = spike_rows(spark, d)
    model = learning.fit_spike_classifier(x, FEATURES, "y", max_iter=ROUNDS)
    scored = learning.positive_probability(model.transform(x.filter("split <> 'train'")))
    cut = learning.best_threshold(scored.filter("split = 'val'"), "y")
    out = scored.filter("split = 'test'").withColumns({"threshold": F.lit(cut), "alarm": F.col("probability") >= cut})
    return out.withColumn("valid", F.col("probability").between(0, 1) & (F.col("alarm") == (F.col("probability") >= F.col("threshold"))))


@query(
    "ml_multiclass_spread", text="point", times="t", ints="cls valid",
    sql=f"""SELECT point, t, CASE WHEN s <= -20 THEN 0 WHEN s <= -5 THEN 1 WHEN s <= 5 THEN 2 WHEN s <= 20 THEN 3 ELSE 4 END AS cls, 1 AS valid FROM (SELECT x.*, x.price - hub *
      0.7071067811865476 AS s, {_SPLIT} AS split FROM ({RTM24}) x JOIN b_hub1h USING (t)) WHERE split = 'test'""",
)
def ml_multiclass_spread(spark, d):
    x = table(spark, d).join(base.b_hub1h(spark, d), "t")
    x = x.withColumn("cls", rules.spread_class(F.col("price") - F.col("hub") * 0.7071067811865476).cast("double"))
    model = learning.fit_multiclass(x, FEATURES, "cls")
    return model.transform(x.filter("split = 'test'")).withColumn("valid", F.col("pred_class").isin(0.0, 1.0, 2.0, 3.0, 4.0))


@query(
    "ml_tuning", ints="rung rounds trials staying distinct_trials in_range best_stays",
    sql="""SELECT rung, rounds, trials, staying, trials AS distinct_trials, trials AS in_range, 1 AS best_stays FROM (VALUES (1, 2, 27, 9), (2, 5, 9, 3), (3, 10, 3, 1)) v(rung, rounds, trials, staying)""",
)
def ml_tuning(spark, d):
    """What is fixed of each rung of the tuning: how many trials it has and keeps, that scores are shares, and that none of those dropped beats one that stays."""
    results, _ = learning.tune_spike(spike_rows(spark, d), FEATURES, "y")
    r = spark.createDataFrame(results)
    worst_kept = F.min(F.when(F.col("stays"), F.col("pr_auc")))
    best_gone = F.coalesce(F.max(F.when(~F.col("stays"), F.col("pr_auc"))), F.lit(0.0))
    return r.groupBy("rung", "rounds").agg(
        F.count("*").alias("trials"), F.count_if("stays").alias("staying"), F.count_distinct("trial").alias("distinct_trials"),
        F.count_if(F.col("pr_auc").between(0, 1)).alias("in_range"), (worst_kept >= best_gone).alias("best_stays"),
    )


MEMBERS = {
    "tree": lambda x: learning.fit_regressor(x, FEATURES, "target_1", max_iter=5),
    "linear": lambda x: learning.fit_linear(x, FEATURES, "target_1"),
}


@query(
    "ml_ensemble", text="point", times="t", ints="between better", nums="target_1 weights",
    sql="SELECT point, t, y AS target_1, 1 AS weights, 1 AS between, 1 AS better FROM kl_rows WHERE split = 'test' AND horizon = 1",
)
def ml_ensemble(spark, d):
    """Test rows with actuals; the sum of the weights, whether the weighted mean lies between its members, and whether the stack beats the last value."""
    x = table(spark, d).filter("target_1 IS NOT NULL")
    out = learning.stacked(x, MEMBERS, "target_1", ["point", "t", "price"], features=FEATURES)
    error = lambda c: F.avg(F.abs(F.col("target_1") - F.col(c)))
    better = out.agg((error("stack") < error("price")).cast("int").alias("better"))
    slack = F.lit(1e-9)
    inside = F.col("weighted").between(F.least("tree", "linear") - slack, F.greatest("tree", "linear") + slack)
    return with_one_row(out.withColumns({"weights": F.col("w_tree") + F.col("w_linear"), "between": inside}), better)


@query(
    "ml_cross_fit", text="point", times="t", ints="fold forecasts",
    sql="""SELECT point, t, floor((epoch(t) - a) * 3 / (b - a + 1)) + 1 AS fold, 2 AS forecasts FROM kl_rows, (SELECT epoch(min(t)) AS a, epoch(max(t)) AS b FROM kl_rows
      WHERE split = 'train' AND horizon = 1) WHERE split = 'train' AND horizon = 1""",
)
def ml_cross_fit(spark, d):
    """Train rows with their block of time and how many members have forecast them from the other blocks."""
    x = table(spark, d).filter("target_1 IS NOT NULL")
    out = learning.cross_fitted(x, MEMBERS, "t")
    return out.withColumn("forecasts", F.col("tree").isNotNull().cast("int") + F.col("linear").isNotNull().cast("int"))


@query(
    "ml_batch_score", text="model point", times="target_time", ints="known",
    sql=f"""SELECT 'rtm_1h' AS model, point, t + INTERVAL 1 HOUR AS target_time, 1 AS known FROM ({RTM24}) x JOIN (SELECT point, max(d) AS d FROM (SELECT point, CAST(t AS DATE) AS d FROM
      ({RTM24}) GROUP BY 1, 2 HAVING count(DISTINCT hour(t)) >= 20) GROUP BY 1) n USING (point) WHERE CAST(x.t AS DATE) = n.d""",
)
def ml_batch_score(spark, d):
    x = table(spark, d).withColumn("day", F.col("t").cast("date"))
    stored = sink.scratch_path(spark, "model")
    learning.save_model(learning.fit_regressor(x, FEATURES, "target_1", max_iter=ROUNDS), stored)
    model = learning.load_model(stored)
    newest = learning.latest_day(x, ["point"], "day", "hour", need=20)
    rows = model.transform(newest).select(
        F.lit("rtm_1h").alias("model"), "point", F.timestamp_seconds(F.unix_timestamp("t") + 3600).alias("target_time"),
        F.col("pred").alias("predicted_value"), "day", F.lit(1).alias("seq"),
    )
    path = sink.scratch_path(spark, "forecasts")
    keys = ["model", "point", "target_time"]
    sink.upsert_parquet(spark, path, rows, keys, "day", "seq")
    return spark.read.parquet(path).withColumn("known", F.col("predicted_value").isNotNull() & ~F.isnan("predicted_value"))


