import numpy as np
import pytest

from gridtide.functions import rules

BOXES = "region string, lat_min double, lat_max double, lon_min double, lon_max double, weight double"


def fold(x):
    return x - 360 if x > 180 else x


def brute(points, boxes):
    parts = []
    for name, s, n, w, e, weight in boxes:
        w, e = fold(w), fold(e)
        parts += [(name, s, n, a, b, weight) for a, b in (((w, 180.0), (-180.0, e)) if w > e else ((w, e),))]
    area = ("all", min(p[1] for p in parts), max(p[2] for p in parts), min(p[3] for p in parts), max(p[4] for p in parts), 1.0)
    return sorted((i, b[0], b[5]) for i, y, x in points for b in [*parts, area] if y is not None and x is not None and b[1] <= y <= b[2] and b[3] <= fold(x) <= b[4])


@pytest.mark.parametrize("cell", [1.0, 7.3])
def test_points_meet_boxes_on_a_grid(spark, cell):
    rng = np.random.default_rng(8)
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-20, 20, 400), rng.uniform(0, 360, 400)))]
    points += [(900, 5.0, 10.0), (901, -3.0, 190.0), (902, None, 1.0), (903, 1.0, None), (904, 12.0, 180.0), (905, float("nan"), 3.0)]
    boxes = [("r1", -5.0, 5.0, 5.0, 20.0, 0.5), ("r2", 0.0, 12.0, 10.0, 40.0, 0.2), ("wide", -10.0, 10.0, 200.0, 300.0, 0.1), ("date", -4.0, 12.0, 170.0, 200.0, 0.3), ("dot", 5.0, 5.0, 10.0, 10.0, 0.7)]
    frame = spark.createDataFrame(points, "i int, lat double, lon double")
    out = rules.region_assign(frame, spark.createDataFrame(boxes, BOXES), "lat", "lon", cell=cell)
    want = brute([p for p in points if p[1] is None or p[1] == p[1]], boxes)
    assert sorted((r.i, r.region, r.weight) for r in out.collect()) == want and len({r for _, r, _ in want}) == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rules.region_assign(frame.limit(0), spark.createDataFrame(boxes, BOXES), "lat", "lon").count() == 0
