import math

import numpy as np
import pytest

from gridtide.llm import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x array<long>, _place string"


def plain(rows):
    """What the query must return but for signs, with numpy over Python integers."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        apart = [n * x[j] - sums[j] for j in range(d)]
        white = (np.array(apart) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out += [(i, k + 1, n, sum(a * a for a in apart), white[k], values[k] / values.sum()) for k in range(min(16, d))]
    return out


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


def compare(spark, folder, data):
    frame = spark.createDataFrame([(i, v, None, None, "c") for i, v in data], SCHEMA).repartition(3)
    frame.write.parquet(f"{folder}/embeddings.parquet")
    found = by_row([tuple(r) for r in op12_whitening.op12_whitening(spark, folder).collect()])
    wanted = by_row(plain(data))
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    signs = {}
    for f, w in zip(found, wanted):
        assert f[5] == pytest.approx(w[5], rel=1e-6) and 0 <= f[6] < 1e-6
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(f[1], np.sign(f[4] * w[4])) == np.sign(f[4] * w[4])
        assert abs(f[4]) == pytest.approx(abs(w[4]), abs=1e-6)


def test_whitening_equals_numpy(spark, folder):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((20, 20)) * (1 / (1 + np.arange(20)))
    data = [(i, (rng.standard_normal(20) @ mix + 3).astype(np.float32).tolist()) for i in range(3000)]
    hot = data[0][1]
    data += [(5000 + i, hot) for i in range(1500)] + [(None, hot), (7, data[7][1]), (8, None), (9, []), (10, [1.0] * 19 + [None])]
    data += [(11, [float("nan")] + [0.0] * 19), (12, [float("inf")] + [0.0] * 19)]
    compare(spark, folder, data)


def test_fewer_dimensions_than_components(spark, folder):
    rng = np.random.default_rng(6)
    compare(spark, folder, [(i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(200)])


def test_edge_rows(spark, folder):
    write = lambda data, name: spark.createDataFrame([(i, v, None, None, "c") for i, v in data], SCHEMA).write.parquet(f"{folder}/{name}/embeddings.parquet")
    write([], "none")
    write([(i, [1.0, 2.0]) for i in range(5)], "equal")
    write([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [1e30, 0.0])], "flat")
    assert op12_whitening.op12_whitening(spark, f"{folder}/none").count() == 0
    assert op12_whitening.op12_whitening(spark, f"{folder}/equal").count() == 0
    rows = op12_whitening.op12_whitening(spark, f"{folder}/flat").collect()
    assert sorted((r.vec_id, r.component, r.n) for r in rows) == [(1, 1, 2), (2, 1, 2)] and {abs(r.whitened) for r in rows} == {1.0}


def test_index_has_no_gaps_and_deviation_tells_overflow(spark):
    rows = spark.range(1000).repartition(7)
    found = [r.n for r in op12_whitening.indexed(rows, "n").select("n").collect()]
    assert sorted(found) == list(range(1000))
    model = op12_whitening.Whitening(4, [0], np.ones(1), np.ones((1, 1)), 1.0, 0.0)
    frame = spark.createDataFrame([([3],), ([1 << 50],)], "x array<long>")
    assert [r.d for r in frame.select(op12_whitening.deviation("x", model).alias("d")).collect()] == [144, None]
