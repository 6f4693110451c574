"""Model fitting and scoring over feature tables with ``pyspark.ml``.

One pooled model per horizon learns all points at once (the point is an indexed
feature), so training is one distributed job whatever the number of points.
"""

from __future__ import annotations

import math
import random
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

SEED = 7


@contextmanager
def kept(df: DataFrame):
    """Rows read once per boosting round: kept on executors (memory, then disk) while a fit runs."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _prepare(features: list[str], point: str | None) -> list:
    stages, inputs = [], list(features)
    if point:
        stages.append(StringIndexer(inputCol=point, outputCol="_point", handleInvalid="keep"))
        inputs.append("_point")
    # a missing feature is filled with its median of the fitted rows, so no row is left out; the assembler fails on anything else
    filled = [f"_filled_{f}" for f in features]
    fill = Imputer(inputCols=features, outputCols=filled, strategy="median")
    names = [*filled, *inputs[len(features) :]]
    return [*stages, fill, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")]


def as_doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as DOUBLE, NaN as missing."""
    return df.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features})


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted model in a shared folder, in place of an older one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, spark) -> DataFrame:
    """feature, importance of a fitted tree model, in the order of its inputs."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [n.removeprefix("_filled_") for n in assembler.getInputCols()]
    return spark.createDataFrame([*zip(names, map(float, model.stages[-1].featureImportances.toArray()))], "feature STRING, importance DOUBLE")


def best_threshold(scored: DataFrame, label: str, probability: str = "probability", steps: int = 100) -> float:
    """Probability cut with the best F1 on the given (validation) rows, on a grid of equal steps; the higher cut wins ties, 0.5 without positives.

    One aggregate by grid step; the driver sees at most steps + 1 rows.
    """
    step = F.least(F.floor(F.col(probability) * steps), F.lit(steps)).cast("int").alias("s")
    table = scored.where(F.col(label).isNotNull()).groupBy(step).agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n")).collect()
    positives = sum(r.p for r in table)
    best, cut, tp, flagged = 0.0, 0.5, 0, 0
    for r in sorted(table, key=lambda r: -r.s):
        tp, flagged = tp + r.p, flagged + r.n
        f1 = 2 * tp / (flagged + positives) if positives else 0.0
        if f1 > best:
            best, cut = f1, r.s / steps
    return cut


def split_column(t: str, train_end: str, val_end: str) -> Column:
    c = F.col(t)
    return F.when(c < F.lit(train_end).cast("timestamp"), "train").when(c < F.lit(val_end).cast("timestamp"), "val").otherwise("test")


def fit_regressor(df: DataFrame, features: list[str], label: str, point: str | None = "point", **params) -> PipelineModel:
    """Boosted trees; rows of split "val" stop the boosting early."""
    rows = df.filter("split <> 'test'").filter(F.col(label).isNotNull()).withColumn("is_val", F.col("split") == "val")
    booster = GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="pred", validationIndicatorCol="is_val", seed=SEED,
        maxIter=params.get("max_iter", 100), maxDepth=params.get("max_depth", 4), stepSize=params.get("step", 0.1),
    )
    with kept(rows) as r:
        return Pipeline(stages=[*_prepare(features, point), booster]).fit(r)


def fit_linear(df: DataFrame, features: list[str], label: str, reg: float = 0.01) -> PipelineModel:
    rows = df.filter("split = 'train'").filter(F.col(label).isNotNull())
    lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred", regParam=reg)
    with kept(rows) as r:
        return Pipeline(stages=[*_prepare(features, None), lr]).fit(r)


def fit_spike_classifier(df: DataFrame, features: list[str], label: str, point: str | None = "point", max_iter: int = 60) -> PipelineModel:
    """Boosted classifier with positives weighted by neg / pos; rows of split "val" stop the boosting early."""
    rows = df.filter("split <> 'test'").filter(F.col(label).isNotNull()).withColumn("is_val", F.col("split") == "val")
    with kept(rows) as r:
        balance = r.filter("NOT is_val").agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.count("*").alias("n")).first()
        weight = (balance.n - balance.p) / max(balance.p, 1)
        weighted = r.withColumn("w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))
        gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="w", validationIndicatorCol="is_val", maxIter=max_iter, maxDepth=4, seed=SEED)
        return Pipeline(stages=[*_prepare(features, point), gbt]).fit(weighted)


def fit_multiclass(df: DataFrame, features: list[str], label: str, point: str | None = "point", trees: int = 30) -> PipelineModel:
    rows = df.filter("split = 'train'").filter(F.col(label).isNotNull())
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, predictionCol="pred_class", numTrees=trees, maxDepth=6, seed=SEED)
    with kept(rows) as r:
        return Pipeline(stages=[*_prepare(features, point), rf]).fit(r)


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("probability", vector_to_array("probability")[1])


def predict_with_bounds(model: PipelineModel, df: DataFrame, label: str, keys: list[str], coverage: float = 0.8) -> DataFrame:
    """Test forecasts with bands from the validation residuals of each key."""
    from .generation import conformal

    scored = model.transform(df.filter("split <> 'train'"))
    return conformal(scored, keys, F.col("split") == "val", label, "pred", coverage)


#: Tuning space of the spike classifier: name -> (low, high, scale), drawn for each trial.
SPACE = {"maxDepth": (2, 6, "int"), "stepSize": (0.02, 0.4, "log"), "subsamplingRate": (0.5, 1.0, "real"), "minInstancesPerNode": (1, 60, "int"), "positive": (0.25, 1.5, "real")}


def draw_trials(n: int, seed: int = SEED) -> list[dict]:
    """Parameters of n trials, drawn once by seed."""
    rng = random.Random(seed)
    kinds = {
        "int": lambda low, high: rng.randint(low, high),
        "real": lambda low, high: rng.uniform(low, high),
        "log": lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high))),
    }
    return [{"trial": i, **{k: kinds[kind](low, high) for k, (low, high, kind) in SPACE.items()}} for i in range(n)]


def tune_spike(
    df: DataFrame, features: list[str], label: str, trials: int = 27, rungs: tuple[int, ...] = (2, 5, 10), keep: int = 3, at_once: int = 4
) -> tuple[list[dict], PipelineModel]:
    """Successive halving on PR-AUC: (one entry a trial and rung, the pipeline of the best trial).

    Every drawn trial is boosted for the first rung's rounds on the train rows and scored on the validation rows; one in `keep` goes on to the next rung
    with more rounds. So most of the work goes to parameters that do well. The weight of positives is a share of negatives / positives. Trials of a
    rung run side by side (`at_once` fits), each as distributed as ever; the prepared rows are kept on the executors over all fits.
    """
    prep = Pipeline(stages=_prepare(features, "point")).fit(df.filter("split = 'train'"))
    score = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderPR")
    results: list[dict] = []
    with kept(prep.transform(df.filter(F.col(label).isNotNull() & (F.col("split") != "test"))).select("features", label, "split")) as rows:
        balance = rows.filter("split = 'train'").agg(F.sum(F.col(label)).alias("p"), F.count("*").alias("n")).first()
        ratio = (balance.n - (balance.p or 0)) / max(balance.p or 0, 1)
        val = rows.filter("split = 'val'")

        def run(trial: dict, rung: int, rounds: int) -> tuple[dict, object]:
            train = rows.filter("split = 'train'").withColumn("w", F.when(F.col(label) == 1, float(trial["positive"] * ratio)).otherwise(1.0))
            settings = {k: v for k, v in trial.items() if k not in ("trial", "positive")}
            model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="w", maxIter=rounds, seed=SEED, **settings).fit(train)
            return {"rung": rung, "rounds": rounds, **trial, "pr_auc": score.evaluate(model.transform(val))}, model

        left, best = draw_trials(trials), None
        for rung, rounds in enumerate(rungs, 1):
            with ThreadPool(at_once) as pool:
                done = pool.map(lambda trial, rung=rung, rounds=rounds: run(trial, rung, rounds), left)
            done.sort(key=lambda x: (-x[0]["pr_auc"], x[0]["trial"]))
            stay = max(1, len(left) // keep) if rung < len(rungs) else 1
            results += [{**entry, "stays": i < stay} for i, (entry, _) in enumerate(done)]
            best = done[0][1]
            left = [{k: entry[k] for k in ("trial", *SPACE)} for entry, _ in done[:stay]]
    return results, PipelineModel(stages=[*prep.stages, best])


def time_folds(df: DataFrame, t: str, folds: int) -> DataFrame:
    """Add fold 1 .. folds: contiguous blocks of equal length between the first and the last time."""
    from ..operators.fill import with_one_row

    s = F.unix_timestamp(t)
    spans = with_one_row(df, df.agg(F.min(s).alias("_first"), F.max(s).alias("_last")))
    at = F.floor((s - F.col("_first")) * folds / (F.col("_last") - F.col("_first") + 1)) + 1
    return spans.withColumn("fold", at.cast("int")).drop("_first", "_last")


def _forecast(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """df with a model's forecast under a name, without the columns that its stages add."""
    return model.transform(df).select(*df.columns, F.col("pred").alias(name))


def cross_fitted(df: DataFrame, members: dict, t: str, folds: int = 3) -> DataFrame:
    """Train rows with their fold and a forecast of each member, made by one that has not seen the fold.

    members: name -> function that fits a model to a frame with a split column. For each fold it gets all rows but the fold's, and the validation rows to
    stop early by. Folds are blocks of time, so neighbours of a row, which share most of its history, are mostly in its own fold.
    """
    train = time_folds(df.filter("split = 'train'"), t, folds)
    val = df.filter("split = 'val'").withColumn("fold", F.lit(0))
    rows, out = train.unionByName(val), None
    for k in range(1, folds + 1):
        part = train.filter(F.col("fold") == k)
        for name, fit in members.items():
            part = _forecast(fit(rows.filter(F.col("fold") != k)), part, name)
        out = part if out is None else out.unionByName(part)
    return out


def stacked(df: DataFrame, members: dict, label: str, keys: list[str], t: str = "t", features: list[str] | None = None, folds: int = 3) -> DataFrame:
    """Test rows with each member's forecast, their inverse-error mean (weights from the validation rows) and a linear stack.

    The stack learns from out-of-fold forecasts of the train rows (see cross_fitted), with the original features beside them if given; the members that
    score the test rows are fitted to all train rows. members: name -> function that fits a model.
    """
    from ..operators.fill import with_one_row
    from ..operators.metrics import inverse_error_weights

    known, names = df.filter(F.col(label).isNotNull()), list(members)
    apart = cross_fitted(known, members, t, folds)
    meta = Pipeline(stages=[*_prepare([*names, *(features or [])], None), LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred")]).fit(apart)
    out = df.filter("split <> 'train'")
    for name, fit in members.items():
        out = _forecast(fit(known), out, name)
    weights = inverse_error_weights(out.filter("split = 'val'").filter(F.col(label).isNotNull()), label, names)
    mean = sum((F.col(n) * F.col(f"w_{n}") for n in names), F.lit(0.0))
    test = with_one_row(out.filter("split = 'test'"), weights).withColumn("weighted", mean)
    return _forecast(meta, test, "stack").select(*keys, label, *names, *(f"w_{n}" for n in names), "weighted", "stack")


def latest_day(df: DataFrame, keys: list[str], day: str, hour: str, need: int) -> DataFrame:
    """Rows of each key's newest day with at least ``need`` hours."""
    full = df.groupBy(*keys, day).agg(F.count_distinct(hour).alias("_h")).filter(F.col("_h") >= need)
    return df.join(full.groupBy(*keys).agg(F.max(day).alias(day)), [*keys, day], "left_semi")
