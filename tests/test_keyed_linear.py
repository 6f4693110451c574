import numpy as np
import pandas as pd
import pytest

from gridtide.plans import keyed_linear


def frame(rng, key, n, weights, noise=0.1, level=0.0):
    x = rng.normal(level, 1, (n, 3))
    return pd.DataFrame({"key": key, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": x @ weights + 5 + rng.normal(0, noise, n)})


def ridge(pdf, lam):
    x, y = pdf[["a", "b", "c"]].to_numpy(float), pdf["y"].to_numpy(float)
    dev = x.std(0)
    z = np.where(dev > 0, (x - x.mean(0)) / np.where(dev > 0, dev, 1), 0)
    beta = np.linalg.solve(z.T @ z + lam * np.eye(3) + np.diag(np.where(dev > 0, 0, len(x))), z.T @ (y - y.mean()))
    coefs = np.where(dev > 0, beta / np.where(dev > 0, dev, 1), 0)
    return coefs, y.mean() - coefs @ x.mean(0)


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_every_key_has_its_own_ridge_fit(spark, level):
    rng = np.random.default_rng(1)
    parts = [frame(rng, f"k{i}", int(rng.integers(5, 200)), rng.normal(0, 3, 3), level=level) for i in range(40)]
    parts.append(parts[0].assign(key=None))
    flat = frame(rng, "flat", 50, np.ones(3))
    parts.append(flat.assign(b=2.0))
    table = pd.concat(parts)
    df = spark.createDataFrame(table.astype({"key": object}).where(table.notna(), None)).repartition(5)
    models = keyed_linear.fit_by_key(df, ["key"], ["a", "b", "c"], "y", 0.5)
    found = {r.key: r for r in models.collect()}
    assert len(found) == 42
    for key, own in table.groupby("key", dropna=False):
        key = None if pd.isna(key) else key
        coefs, intercept = ridge(own, 0.5)
        assert found[key].n == len(own)
        assert found[key].coefs == pytest.approx(coefs, rel=1e-5, abs=1e-6)
        assert found[key].intercept == pytest.approx(intercept, rel=1e-5, abs=1e-4)
    assert found["flat"].coefs[1] == 0
    steep = keyed_linear.gradients(df, models, ["key"], ["a", "b", "c"], "y", 0.5).collect()
    assert len(steep) == 126 and max(abs(r.gradient) for r in steep) < 1e-6
    top = keyed_linear.coefficients(models, ["key"], ["a", "b", "c"]).filter("rank = 1 and key = 'k1'").first()
    assert top.feature == "abc"[int(np.argmax(np.abs(np.array(found["k1"].importance))))]


def test_missing_values_and_keys_without_a_model(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", 2.0, 1.0, 5.0), ("a", 3.0, 5.0, 6.5), ("a", float("nan"), 1.0, 9.0), ("a", None, 1.0, 9.0), ("b", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "key string, u double, v double, y double")
    models = keyed_linear.fit_by_key(df, ["key"], ["u", "v"], "y")
    assert [(r.key, r.n) for r in models.collect()] == [("a", 3)]
    scored = keyed_linear.score_by_key(df, models, ["key"], ["u", "v"]).collect()
    assert len(scored) == 6 and [r.pred is None for r in scored] == [r.key == "b" for r in scored]
    m = models.first()
    for r in scored:
        if r.key == "a" and (r.u is None or r.u != r.u):
            assert r.pred == pytest.approx(m.intercept + m.coefs[0] * 2.0 + m.coefs[1] * 1.0)
    assert keyed_linear.fit_by_key(df.limit(0), ["key"], ["u", "v"], "y").count() == 0
