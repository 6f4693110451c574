"""Linear models of very many keys at once: one model a key (point and horizon), all fitted by one aggregation.

A ridge regression needs of a key's rows only their number, means and covariances. These are mergeable aggregates, so fitting a million keys is one
partially aggregated groupBy, and solving is a fold over small arrays of each key's own row. No loop over keys, no key's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ratio


def _complete(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def moments(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """n, means (features, then the label) and cov (upper triangle by rows, the label as last column) of the complete rows of each key."""
    names = [*features, label]
    x = {c: F.col(c).cast("double") for c in names}
    pairs = [F.covar_pop(x[a], x[b]) for i, a in enumerate(features) for b in names[i:]]
    return df.filter(_complete(names)).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(x[c]) for c in names]).alias("means"), F.array(*pairs).alias("cov"))


def _solve(system: Column, size: int) -> Column:
    """Last column of a symmetric positive definite system (rows with the right side appended) after elimination, as a fold over the pivots."""

    def pivot(rows: Column, k: Column) -> Column:
        top = F.get(rows, k)
        return F.transform(
            rows,
            lambda row, i: F.when(i == k, F.transform(row, lambda x: x / F.get(top, k))).otherwise(
                F.zip_with(row, top, lambda x, y: x - F.get(row, k) / F.get(top, k) * y)
            ),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, pivot)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def fit_by_key(df: DataFrame, keys: list[str], features: list[str], label: str, ridge: float = 1.0) -> DataFrame:
    """Per key: n, means, intercept, coefs and importance (coefficients of standardised features) of a ridge regression over its complete rows.

    The penalty is ``ridge`` on standardised coefficients against the sum of squares, the intercept is free. A feature that does not vary within a
    key gets 0; a key without complete rows has no model.
    """
    p = len(features)
    at = {}
    for i in range(p):
        for j in range(i, p + 1):
            at[i, j] = at[j, i] = len({*at.values()})
    m = moments(df, keys, features, label)
    m = m.withColumn("dev", F.array(*[F.sqrt(F.get("cov", F.lit(at[i, i]))) for i in range(p)]))
    dev = lambda i: F.get("dev", F.lit(i))
    still = lambda i: F.coalesce(dev(i) == 0, F.lit(True))

    def entry(i: int, j: int) -> Column:
        cov = F.get("cov", F.lit(at[i, j]))
        if j == p:
            return F.when(still(i), 0.0).otherwise(cov / dev(i))
        value = F.lit(1.0) if i == j else F.when(still(i) | still(j), 0.0).otherwise(cov / (dev(i) * dev(j)))
        return value + F.lit(ridge) / F.col("n") if i == j else value

    m = m.withColumn("system", F.array(*[F.array(*[entry(i, j) for j in range(p + 1)]) for i in range(p)]))
    m = m.withColumn("importance", _solve(F.col("system"), p))
    m = m.withColumn("coefs", F.zip_with("importance", "dev", lambda b, s: F.when(s > 0, b / s).otherwise(0.0)))
    level = F.aggregate(F.zip_with("coefs", F.slice("means", 1, p), lambda b, x: b * x), F.lit(0.0), lambda acc, x: acc + x)
    m = m.withColumn("intercept", F.get("means", F.lit(p)) - level)
    return m.select(*keys, "n", "means", "dev", "intercept", "coefs", "importance")


def score_by_key(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], pred: str = "pred") -> DataFrame:
    """df with the forecast of its key's model (NULL without one); a missing feature counts as the mean that the model was fitted with."""
    named = models.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("intercept").alias("_b"), F.col("coefs").alias("_c"), F.col("means").alias("_m"))
    j = df.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    value = F.col("_b")
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        value = value + F.get("_c", F.lit(i)) * F.coalesce(F.when(~F.isnan(x), x), F.get("_m", F.lit(i)))
    return j.withColumn(pred, value).drop("_b", "_c", "_m", *[f"_k_{k}" for k in keys])


def coefficients(models: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row a key and feature: coefficient, importance (of the standardised feature), and its rank by size."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("coefs", F.lit(i)).alias("coefficient"), F.get("importance", F.lit(i)).alias("importance")) for i, f in enumerate(features)])
    by_size = lambda a, b: F.when(F.abs(a["importance"]) > F.abs(b["importance"]), -1).when(F.abs(a["importance"]) < F.abs(b["importance"]), 1).otherwise(
        F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    )
    ranked = models.select(*keys, "n", F.posexplode(F.array_sort(rows, by_size)).alias("_at", "_row"))
    return ranked.select(*keys, "n", (F.col("_at") + 1).alias("rank"), "_row.feature", "_row.coefficient", "_row.importance")


def gradients(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], label: str, ridge: float = 1.0) -> DataFrame:
    """Left sides of the normal equations of each key and feature, from the rows again: cov(x, y - pred) / dev(x) - ridge / n * importance; 0 at the fit."""
    rows = score_by_key(df.filter(_complete([*features, label])), models, keys, features, "_pred")
    rest = F.col(label).cast("double") - F.col("_pred")
    again = rows.groupBy(*keys).agg(F.array(*[F.covar_pop(F.col(f).cast("double"), rest) for f in features]).alias("_cov"))
    named = models.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "n", "dev", "importance")
    j = again.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    row = lambda i, f: F.struct(
        F.lit(f).alias("feature"),
        (F.coalesce(ratio(F.get("_cov", F.lit(i)), F.get("dev", F.lit(i))), F.lit(0.0)) - F.lit(ridge) / F.col("n") * F.get("importance", F.lit(i))).alias("gradient"),
    )
    return j.select(*keys, F.inline(F.array(*[row(i, f) for i, f in enumerate(features)])))
