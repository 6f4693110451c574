import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtide.plans import learning


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 240
    t = pd.date_range("2024-01-01", periods=n, freq="h")
    x = rng.normal(0, 1, (n, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"point": np.where(np.arange(n) % 2, "a", "b"), "t": t, "a": x[:, 0], "b": x[:, 1], "y": y, "spike": (y > 2).astype(float)})
    pdf["split"] = np.where(np.arange(n) < 160, "train", np.where(np.arange(n) < 200, "val", "test"))
    return spark.createDataFrame(pdf)


class Seen:
    """A member that remembers the rows it was fitted to: its forecast is 1 for those and 0 for others."""

    def __init__(self):
        self.fits = []

    def __call__(self, df):
        times = df.filter("split = 'train'").select("t").distinct()
        self.fits.append(times)
        return self.Model(times)

    class Model:
        def __init__(self, times):
            self.times = times

        def transform(self, df):
            return df.join(self.times.withColumn("_seen", F.lit(1)), "t", "left").withColumn("pred", F.coalesce("_seen", F.lit(0)).cast("double"))


def test_no_row_is_scored_by_a_member_that_saw_it(table):
    member = Seen()
    out = learning.cross_fitted(table, {"m": member}, "t", 4).collect()
    assert len(member.fits) == 4 and len(out) == 160
    assert {r.m for r in out} == {0.0} and sorted({r.fold for r in out}) == [1, 2, 3, 4]
    ends = [(min(r.t for r in out if r.fold == k), max(r.t for r in out if r.fold == k)) for k in (1, 2, 3, 4)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("features", [None, ["a", "b"]])
def test_stack_is_better_than_a_poor_member(table, features):
    members = {"good": lambda x: learning.fit_linear(x, ["a", "b"], "y"), "poor": lambda x: learning.fit_linear(x, ["b"], "y")}
    out = learning.stacked(table, members, "y", ["point", "t"], features=features).toPandas()
    assert len(out) == 40 and np.allclose(out["w_good"] + out["w_poor"], 1) and out["w_good"][0] > 0.6
    error = lambda c: (out[c] - out["y"]).abs().mean()
    assert error("stack") < 0.5 * error("poor") and error("stack") < 1.2 * error("good") and error("weighted") < error("poor")


def test_halving_keeps_the_best(table):
    trials = learning.draw_trials(6)
    assert trials == learning.draw_trials(6) and len({t["stepSize"] for t in trials}) == 6
    results, model = learning.tune_spike(table, ["a", "b"], "spike", trials=6, rungs=(1, 3), keep=3)
    first, second = ([r for r in results if r["rung"] == k] for k in (1, 2))
    assert (len(first), len(second)) == (6, 2) and sum(r["stays"] for r in first) == 2
    assert {r["trial"] for r in second} == {r["trial"] for r in first if r["stays"]}
    assert min(r["pr_auc"] for r in first if r["stays"]) >= max(r["pr_auc"] for r in first if not r["stays"])
    assert max(r["pr_auc"] for r in second) > 0.8
    assert "probability" in model.transform(table).columns
