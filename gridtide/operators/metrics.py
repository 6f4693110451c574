"""Forecast and classifier evaluation as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import clamp
from .fill import with_one_row
from .ranked import exact_quantiles, prefix_scan, row_index, value_chunks


def _zero_div(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def error_metrics(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, MAPE (rows with a zero actual have no percentage) and count."""
    e = F.col(pred) - F.col(actual)
    pct = F.abs(F.try_divide(e, F.col(actual)) * 100)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(pct).alias("mape"), F.count("*").alias("n")
    )


def error_metric_variants(df: DataFrame, keys: list[str], capacity: float, actual: str = "actual", pred: str = "pred") -> DataFrame:
    y, e = F.col(actual), F.col(pred) - F.col(actual)
    rel = F.abs(F.try_divide(e, y)) * 100
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    m = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(F.when(F.abs(y) > 1, rel)).alias("mape_over_1"), F.avg(rel).alias("mape_nonzero"),
        (F.avg(F.abs(e) / (F.abs(y) + 1e-8)) * 100).alias("mape_eps"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
    )
    return m.withColumns({"nmae": F.col("mae") / capacity * 100, "nrmse": F.col("rmse") / capacity * 100})


def skill(df: DataFrame, keys: list[str], actual: str, pred: str, baseline: str) -> DataFrame:
    mae, base = F.avg(F.abs(F.col(pred) - F.col(actual))), F.avg(F.abs(F.col(baseline) - F.col(actual)))
    rows = df.filter(F.col(baseline).isNotNull())
    m = rows.groupBy(*keys).agg(mae.alias("mae"), base.alias("mae_baseline"))
    score = F.when(F.col("mae_baseline") == 0, 0.0).otherwise(1 - F.try_divide(F.col("mae"), F.col("mae_baseline")))
    return m.withColumns({"skill": score, "improvement_pct": score * 100})


def interval_metrics(df: DataFrame, keys: list[str], y: str, low: str, high: str, q_low: float = 0.1, q_high: float = 0.9) -> DataFrame:
    """Pinball losses of both bounds, coverage, sharpness and Winkler score."""
    t, lo, hi = F.col(y), F.col(low), F.col(high)
    alpha = q_low + (1 - q_high)

    def pinball(q: float, p: Column) -> Column:
        return F.avg(F.greatest(q * (t - p), (q - 1) * (t - p)))

    penalty = F.when(t < lo, 2 * (lo - t) / alpha).when(t > hi, 2 * (t - hi) / alpha).otherwise(0.0)
    return df.groupBy(*keys).agg(
        pinball(q_low, lo).alias("pinball_low"), pinball(q_high, hi).alias("pinball_high"),
        F.avg(((t >= lo) & (t <= hi)).cast("double")).alias("coverage"), F.avg(hi - lo).alias("sharpness"),
        F.avg(hi - lo + penalty).alias("winkler"),
    )


def residual_quantiles(df: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    r = df.withColumn("_r", F.col(actual) - F.col(pred))
    m = r.groupBy(*keys).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"))
    ps = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return m.join(exact_quantiles(r, keys, "_r", ps), keys)


def confusion(df: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    t, p = F.col(y) == 1, F.col(yhat) == 1
    m = df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"), F.count("*").alias("n"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f1_neg = _zero_div(2 * tp, 2 * tp + fp + fn), _zero_div(2 * tn, 2 * tn + fp + fn)
    return m.withColumns(
        {
            "precision": _zero_div(tp, tp + fp),
            "recall": _zero_div(tp, tp + fn),
            "f1": f1,
            "accuracy": (tp + tn) / F.col("n"),
            "macro_f1": (f1 + f1_neg) / 2,
            "weighted_f1": (f1 * (tp + fn) + f1_neg * (tn + fp)) / F.col("n"),
            "positive_rate": (tp + fn) / F.col("n"),
        }
    )


def _score_curve(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """One row per tied score with cumulative true and false positives, highest score first.

    Ties are merged by a partial aggregate, then scanned in score ranges of about
    equal size, so neither a popular score nor a big key gathers in one task.
    """
    s = F.col(score)
    ties = df.groupBy(*keys, s.alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg")
    )
    ranged, chunk = value_chunks(ties, "score")
    cum = prefix_scan(
        ranged, keys, chunk, [F.desc("score")], sums={"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, descending=True
    ).drop("_limits")
    totals = ties.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return cum.join(totals, keys) if keys else with_one_row(cum, totals)


def roc_pr_auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """ROC-AUC, average precision, best precision at recall >= 0.5; NULL when one class is absent."""
    c = _score_curve(df, keys, y, score)
    pos, neg, tp, fp = (F.col(x).cast("double") for x in ("pos", "neg", "cum_pos", "cum_neg"))
    prec = tp / (tp + fp)
    m = c.groupBy(*keys).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"),
        F.sum(neg * (tp - pos / 2)).alias("_area"), F.sum(pos * prec).alias("_ap"),
        F.max(F.when(F.try_divide(tp, F.col("n_pos")) >= 0.5, prec)).alias("_p50"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return m.withColumns(
        {
            "roc_auc": F.when(both, F.try_divide(F.col("_area"), F.col("n_pos") * F.col("n_neg"))),
            "pr_auc": F.when(both, F.try_divide(F.col("_ap"), F.col("n_pos"))),
            "precision_at_recall_50": F.when(both, F.col("_p50")),
        }
    ).drop("_area", "_ap", "_p50")


def pr_curve_points(df: DataFrame, y: str, score: str, points: int = 20) -> DataFrame:
    """Precision/recall at ``points`` evenly spaced positions of the curve, lowest score first; the last is (1, 0)."""
    c = _score_curve(df, [], y, score)
    ranged, chunk = value_chunks(c, "score")
    curve = row_index(ranged, [], chunk, [F.col("score")])
    size = curve.agg(F.max("rn").alias("_n"), F.first("n_pos").alias("_p"))
    at = (F.col("i") * (F.col("_n") / F.lit(float(points - 1)))).cast("long")
    wanted = size.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "_n", "_p").withColumn("rn", at + 1)
    hit = wanted.join(curve.select("rn", "cum_pos", "cum_neg"), "rn", "left")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    return hit.select(
        "i", F.coalesce(tp / (tp + fp), F.lit(1.0)).alias("precision"), F.coalesce(tp / F.col("_p"), F.lit(0.0)).alias("recall")
    )


def precision_at_k(df: DataFrame, y: str, score: str, tie: str, multiples: list[int]) -> DataFrame:
    """Precision of the k best scores, k = multiples of the positives; ties by ``tie`` ascending.

    The cut of each k is found in the table of tied scores; only the rows of the tie group that a cut falls in are ranked.
    """
    curve = _score_curve(df, [], y, score)
    m = curve.withColumn("mult", F.explode(F.array(*[F.lit(x) for x in multiples])))
    upto, group = F.col("cum_pos") + F.col("cum_neg"), F.col("pos") + F.col("neg")
    k = F.least(F.col("n_pos") * F.col("mult"), F.col("n_pos") + F.col("n_neg"))
    cut = m.filter((k > upto - group) & (k <= upto)).select(
        "mult", k.alias("k"), F.col("score").alias("_cut"), (k - upto + group).alias("_need"), (F.col("cum_pos") - F.col("pos")).alias("_above")
    )
    at = df.join(F.broadcast(cut.select("_cut").distinct()), F.col(score) == F.col("_cut"))  # one row for each multiple at most
    ranged, chunk = value_chunks(at, tie)
    first = row_index(ranged, ["_cut"], chunk, [F.col(tie)]).join(F.broadcast(cut), "_cut").filter(F.col("rn") <= F.col("_need"))
    return first.groupBy("mult").agg(
        F.first("k").alias("k"), ((F.first("_above") + F.sum(F.col(y).cast("long"))) / F.first("k")).alias("precision")
    )


def class_balance(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) != 1)
    return df.groupBy(*keys).agg(
        pos.alias("pos"), neg.alias("neg"), (neg / F.greatest(pos, F.lit(1))).alias("scale"),
        (F.greatest(pos, neg) / F.count("*")).alias("majority_baseline"),
    )


def class_distribution(df: DataFrame, keys: list[str], cls: str, value: str) -> DataFrame:
    counts = df.groupBy(*keys, cls).agg(F.count("*").alias("n"))
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return counts.join(stats, keys).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def inverse_error_weights(df: DataFrame, actual: str, members: list[str]) -> DataFrame:
    """One row: weight per member, proportional to 1 / (MAE + 1e-8)."""
    mae = df.agg(*[F.avg(F.abs(F.col(m) - F.col(actual))).alias(m) for m in members])
    inv = {m: 1 / (F.col(m) + 1e-8) for m in members}
    total = sum(inv.values(), F.lit(0.0))
    return mae.select(*[(inv[m] / total).alias(f"w_{m}") for m in members])


def weighted_ensemble(df: DataFrame, actual: str, members: list[str]) -> DataFrame:
    w = with_one_row(df, inverse_error_weights(df, actual, members))
    weighted = sum((F.col(m) * F.col(f"w_{m}") for m in members), F.lit(0.0))
    equal = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    up = [F.col(m) > 0 for m in members]
    agree = up[0]
    disagree = ~up[0]
    for u in up[1:]:
        agree, disagree = agree & u, disagree & ~u
    vote = F.when(agree, 1).when(disagree, -1).otherwise(0)
    return w.withColumns({"weighted": weighted, "equal": equal, "vote": vote})


def importance_rollup(df: DataFrame, feature: str, gain: str, top: int = 10) -> DataFrame:
    return df.groupBy(feature).agg(F.avg(gain).alias("mean_gain")).orderBy(F.desc("mean_gain"), feature).limit(top)


def directional_accuracy(df: DataFrame, keys: list[str], t: str, actual: str, pred: str) -> DataFrame:
    """Share of steps whose forecast moves the same way as the actual, both from the last actual."""
    from ..functions.frames import series

    prev = F.lag(actual).over(series(keys, t))
    s = df.withColumn("_prev", prev).filter(F.col("_prev").isNotNull())
    same = (F.col(pred) - F.col("_prev")) * (F.col(actual) - F.col("_prev")) > 0
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("directional_accuracy"))


def ramp_probability(df: DataFrame, point: str, low: str, high: str, current: str, threshold: float) -> DataFrame:
    """Ramp size and up/down probability from a forecast interval."""
    lo, hi, now = F.col(low), F.col(high), F.col(current)
    width = hi - lo + 1e-6
    return df.withColumns(
        {
            "ramp_magnitude": F.col(point) - now,
            "ramp_up_prob": clamp(F.try_divide(hi - now - threshold, width), 0.0, 1.0),
            "ramp_down_prob": clamp(F.try_divide(now - threshold - lo, width), 0.0, 1.0),
        }
    )
