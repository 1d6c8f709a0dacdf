"""Nearest neighbours by broadcast and by packed blocks, against brute force; clusters, places shared by many, far points."""

import numpy as np
import pytest

from terrastat.operators import neighbours
from terrastat.operators.folds import nndm_folds

RNG = np.random.default_rng(3)
MIXED = np.vstack([RNG.random((30, 2)) * 1000, RNG.normal(500, 0.01, (150, 2)), np.full((60, 2), 7.0), np.round(RNG.random((30, 2)) * 3)])


def points(spark, xy):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")


def brute(a, b, k, exclude_self):
    out = []
    for i, (x, y) in enumerate(a):
        d = (b[:, 0] - x) ** 2 + (b[:, 1] - y) ** 2
        near = [j for j in np.lexsort((np.arange(len(b)), d)) if not (exclude_self and j == i)][:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sent", [0, 10**6])
def test_both_ways_are_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "CHUNK", 40)  # crowded blocks are copied
    for a, b, k, exclude_self in ((MIXED, MIXED, 5, True), (RNG.random((40, 2)) * 3000 - 1000, MIXED, 4, False), (MIXED[:50], MIXED[:3], 5, False)):
        got = sorted((r.i, r.j, r["rank"]) for r in neighbours.knn_join(points(spark, a), points(spark, b), k, exclude_self, sent_rows=sent).collect())
        assert got == brute(a, b, min(k, len(b)), exclude_self)


def test_blocks_hold_equally_many_rows_wherever_they_are(spark):
    """A layer with nine tenths of its points in one spot visits no more blocks than a uniform one."""
    visits = []
    for xy in (RNG.random((4000, 2)) * 1000, np.where(np.arange(4000)[:, None] % 10 > 0, RNG.normal(500, 0.01, (4000, 2)), RNG.random((4000, 2)) * 1000)):
        z = points(spark, xy)
        box = [float(xy[:, 0].min()), float(xy[:, 0].max()), float(xy[:, 1].min()), float(xy[:, 1].max())]
        code = np.array([r[0] for r in z.select(neighbours.z_order(z["x"], z["y"], box)).collect()])
        order = np.lexsort((xy[:, 0], code))
        blocks = [order[k : k + 100] for k in range(0, 4000, 100)]
        boxes = neighbours._Boxes(np.array([[xy[b, 0].min(), xy[b, 0].max(), xy[b, 1].min(), xy[b, 1].max()] for b in blocks]), np.array([code[b].min() for b in blocks]))
        d = np.sort(((xy[::20, None, :] - xy[None]) ** 2).sum(2), 1)[:, 5]
        p, _ = boxes.within(xy[::20, 0], xy[::20, 1], d)
        visits.append(len(p) / len(d))
    assert visits[1] < 3 * visits[0] < 15


def test_points_without_a_place(spark):
    rows = [(1, 0.0, 0.0), (2, float("nan"), 1.0), (3, None, 1.0), (4, 3.0, 4.0), (5, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double")
    assert sorted((r.i, r.j, r.d) for r in neighbours.knn_join(df, df, 3, exclude_self=True).collect()) == [(1, 4, 5.0), (4, 1, 5.0)]
    assert neighbours.knn_join(df, df.limit(0), 2).count() == 0 and neighbours.knn_join(df.limit(0), df, 2).count() == 0
    assert neighbours.knn_join(df, df.where("row_id = 1"), 1, exclude_self=True).count() == 0


def test_plans_of_matched_folds_stay_small(spark):
    p = points(spark, RNG.random((60, 2)) * 100)
    folds = nndm_folds(p, points(spark, RNG.random((20, 2)) * 400))
    plan = folds.excluded._jdf.queryExecution().toString() + folds.params["realised"]._jdf.queryExecution().toString()
    assert plan.count("Window") + plan.count("Exchange") < 60
    assert folds.params["realised"].count() == 60
