"""Random points, seeds, mixed geometries, users' aggregates, guards and criteria of local regression."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.operators import assign, models, seeding
from terrastat.operators.overlay import holds, structs
from terrastat.operators.points import assert_kinds, coerce_mixed
from terrastat.sources.crs import LONGLAT

U = [np.array([[0, 0], [10, 0], [10, 10], [7, 10], [7, 3], [3, 3], [3, 10], [0, 10]], float)]
GEOM = "row_id long, kind string, rings array<array<struct<x:double,y:double>>>"


def box(x, y, a):
    return np.array([[x, y], [x + a, y], [x + a, y + a], [x, y + a]], float)


def points(spark, xy, **columns):
    names = list(columns)
    rows = [(i, float(x), float(y), *[float(columns[c][i]) for c in names]) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, ", ".join(["row_id long", "x double", "y double", *[f"{c} double" for c in names]]))


def xy_of(df):
    return np.array([(r.x, r.y) for r in df.collect()])


def test_random_points_are_inside_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(seeding, "CHUNK", 50)
    area = [*U, box(20, 0, 4), box(21, 1, 1)]  # parts apart, one with a hole
    got = seeding.random_points(spark, area, 600, 7)
    xy = xy_of(got)
    assert len(xy) == 600 and holds(xy, area).all() and sorted(r.point_id for r in got.collect()) == list(range(1, 601))
    assert (xy[:, 0] > 15).mean() == pytest.approx(15 / 87, abs=0.05)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = xy_of(seeding.random_points(spark, area, 600, 7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {tuple(p) for p in xy} == {tuple(p) for p in again} and {tuple(p) for p in xy} != {tuple(p) for p in xy_of(seeding.random_points(spark, area, 600, 8))}
    layer = spark.createDataFrame([(structs([box(0, 0, 1)]),), (structs([box(5, 5, 3)]),)], "rings array<array<struct<x:double,y:double>>>")
    assert (xy_of(seeding.random_points(spark, layer, 200))[:, 0] > 4).mean() == pytest.approx(0.9, abs=0.06)
    with pytest.raises(ValueError):
        seeding.random_points(spark, [np.array([[0, 0], [1, 1], [2, 2]], float)], 5)


def test_too_few_points_are_reported(spark, monkeypatch, caplog):
    monkeypatch.setattr(seeding, "ROUNDS", 1)
    sliver = [np.array([[0, 0], [1e6, 1e6], [1e6, 1e6 + 1e-3]], float)]
    monkeypatch.setattr(seeding, "point_in_edges", lambda *a: F.lit(False))
    with caplog.at_level(logging.WARNING):
        assert seeding.random_points(spark, sliver, 3).count() == 0
    assert "0 of 3 points" in caplog.text


def test_seeds(spark, caplog):
    for method in ("random", "kmeans"):
        s = seeding.voronoi_seeds(spark, U, method, 6, starts=2)
        assert sorted(r.seed_id for r in s.collect()) == list(range(1, 7)) and {r.method for r in s.collect()} == {method}
    places = points(spark, [(0, 0), (0, 0), (5, 5)])
    with caplog.at_level(logging.WARNING):
        assert seeding.voronoi_seeds(spark, None, "kmeans", 9, sample_points=places, starts=1).count() == 2
    assert "clamped" in caplog.text
    given = seeding.voronoi_seeds(spark, seeds=places, method="provided").orderBy("seed_id").collect()
    assert [(r.seed_id, r.x) for r in given] == [(1, 0.0), (2, 0.0), (3, 5.0)]
    for wrong in ({"method": "provided"}, {"method": "random", "n": 3}, {"method": "kmeans", "n": 3}, {"method": "random", "boundary": U}, {"method": "other"}):
        with pytest.raises(ValueError):
            seeding.voronoi_seeds(spark, **wrong)


def mixed(spark):
    shape = lambda *parts: structs([np.array(p, float) for p in parts])
    rows = [(1, "point", shape([(3, 4)])), (2, "multipoint", shape([(0, 0)], [(2, 4)])), (3, "line", shape([(0, 0), (4, 0), (4, 2)])), (4, "multiline", shape([(0, 0), (1, 0)], [(0, 0), (0, 8)])),
            (5, "polygon", shape(box(0, 0, 2))), (6, "multipolygon", shape(box(0, 0, 2), box(10, 10, 4))), (7, "line", None), (8, "polygon", [])]
    return spark.createDataFrame(rows, GEOM)


def test_mixed_layers(spark):
    at = {r.row_id: (r.x, r.y) for r in coerce_mixed(mixed(spark)).collect()}
    assert [at[k] for k in (1, 2, 3, 4, 5)] == [(3, 4), (1, 2), (3, 0), (0, 4), (1, 1)] and at[7] == at[8] == (None, None)
    assert at[6][1] == 7 or at[6][0] in (1, 12)
    boxes = {r.row_id: (r.x, r.y) for r in coerce_mixed(mixed(spark), mode="bbox_center").collect()}
    assert boxes[3] == (2, 1) and boxes[6] == (7, 7)
    assert {r.row_id: (r.x, r.y) for r in coerce_mixed(mixed(spark), mode="centroid").collect()}[6] == pytest.approx((9.8, 9.8))
    assert coerce_mixed(mixed(spark).where("kind = 'line'"), mode="line_midpoint").count() == 2
    with pytest.raises(ValueError):
        coerce_mixed(mixed(spark), mode="line_midpoint")
    with pytest.raises(ValueError, match="not point"):
        assert_kinds(mixed(spark).where("row_id = 1"), ("polygon", "multipolygon"))
    with pytest.raises(ValueError, match="no column"):
        assert_kinds(points(spark, [(0, 0)]), "point")
    with pytest.raises(ValueError):
        coerce_mixed(mixed(spark).withColumn("kind", F.lit("curve")))


def test_midpoints_of_lines_in_degrees(spark):
    """Half the way on the ground is not half the degrees."""
    line = structs([np.array([(10.0, 40.0), (10.0, 60.0), (12.0, 60.0)])])
    df = spark.createDataFrame([(1, "line", line)], GEOM)
    flat, ground = coerce_mixed(df).first(), coerce_mixed(df, crs=LONGLAT).first()
    assert (flat.x, flat.y) == (10.0, 51.0) and ground.x == pytest.approx(10, abs=0.5) and 50.2 < ground.y < 50.8


def test_users_aggregates(spark, caplog):
    p = points(spark, np.zeros((12, 2)), cell_id=[i % 3 for i in range(12)], v=[float(i) if i != 4 else float("nan") for i in range(12)])
    with caplog.at_level(logging.WARNING):
        rows = {r.cell_id: r for r in assign.summarize_by_cell(p, "v", agg_funs={"top": F.max, "spread": assign.Vectorised(lambda v: v.max() - v.min()), "none": 3}).collect()}
    assert rows[1].resp_top_v == 10 and rows[1].resp_spread_v == 9 and rows[1].resp_none_v == pytest.approx(6) and "no aggregate" in caplog.text
    assert {c for c in assign.summarize_by_cell(p, "v", agg_funs=[F.min, assign.Vectorised(len)]).columns if c.startswith("resp")} == {"resp_agg1_v", "resp_agg2_v"}
    empty = points(spark, np.zeros((2, 2)), cell_id=[1, 1], v=[float("nan")] * 2)
    assert assign.summarize_by_cell(empty, "v", agg_funs={"m": assign.Vectorised(lambda v: v.mean())}).first().resp_m_v is None


def regression(spark, n=80):
    rng = np.random.default_rng(5)
    xy, a, b = rng.random((n, 2)) * 100, rng.normal(size=n), rng.normal(size=n)
    return points(spark, xy, a=a, b=b, z=(1 + xy[:, 0] / 50) * a + 0.3 * rng.normal(size=n), c=2 * a, k=np.ones(n), count=np.round(3 * a)), xy, a, b


def test_condition_numbers(spark):
    p, xy, a, b = regression(spark)
    got = {r.row_id: r for r in models.gwr_condition(p, ["a", "b"], 15).collect()}
    for i in (0, 7, 33):
        near = np.argsort(np.hypot(*(xy - xy[i]).T), kind="stable")[:15]
        assert got[i].n == 15 and got[i].condition == pytest.approx(np.linalg.cond(np.column_stack([a, b])[near]))
    within = {r.row_id: r.n for r in models.gwr_condition(p, ["a", "b"], 20.0, adaptive=False).collect()}
    assert within[5] == (np.hypot(*(xy - xy[5]).T) <= 20).sum()
    assert models.gwr_condition(p, ["a", "c"], 15).where("condition < 1e6").count() == 0


def test_local_regression_warns(spark, caplog):
    p, *_ = regression(spark)
    for predictors, response, text in ((["a", "c"], "z", "nearly collinear"), (["a", "k"], "z", "k does not vary"), (["a"], "count", "whole values")):
        caplog.clear()
        with caplog.at_level(logging.WARNING):
            models.fit_gwr(p, response, predictors, 30)
        assert text in caplog.text
    caplog.clear()
    with caplog.at_level(logging.WARNING):
        models.fit_gwr(p, "z", ["a", "b"], 30)
        models.fit_gwr(p, "z", ["a", "c"], 30, checks=False)
    assert not caplog.text


def test_cross_validated_bandwidth_is_that_of_refits(spark):
    p, xy, a, _ = regression(spark, 40)
    z = np.array([r.z for r in p.orderBy("row_id").collect()])
    fit = models.fit_gwr(p, "z", ["a"], 14)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    x, total = np.column_stack([np.ones(40), a]), 0.0
    for i in range(40):  # without row i, at the same kernel
        w = models.kernel_values(d[i], np.sort(d[i])[13], "bisquare")
        w[i] = 0
        total += (z[i] - x[i] @ np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ z)) ** 2
    assert models._cv_score(fit) == pytest.approx(total, rel=1e-9)
    chosen = models.fit_gwr(p, "z", ["a"], criterion="CV")
    assert models._cv_score(chosen) <= min(models._cv_score(models.fit_gwr(p, "z", ["a"], b)) for b in (12, 25, 40)) * 1.05
    with pytest.raises(ValueError):
        models.fit_gwr(p, "z", ["a"], criterion="BIC")
