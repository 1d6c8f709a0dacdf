import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.operators import cv, models, tessellate
from terrastat.operators.folds import random_folds
from terrastat.operators.points import coerce_to_points

from .test_spatial import cloud, points

GEOM = "row_id long, rings array<array<struct<x:double,y:double>>>"


def geom(spark, *parts):
    return spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts])], GEOM)


def at(df):
    r = df.first()
    return r["x"], r["y"]


def test_representative_points(spark):
    ell = geom(spark, [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)])
    assert at(coerce_to_points(ell, "polygon", mode="bbox_center")) == (2.0, 2.0)
    assert at(coerce_to_points(ell, "polygon")) == (0.5, 2.0)
    assert at(coerce_to_points(ell, "polygon", mode="centroid")) == pytest.approx((19 / 14, 19 / 14))
    assert at(coerce_to_points(geom(spark, [(0, 0), (4, 0), (4, 2)]), "line")) == (3.0, 0.0)
    assert at(coerce_to_points(geom(spark, [(0, 0), (1, 0)], [(0, 0), (0, 8)]), "multiline")) == (0.0, 4.0)
    assert at(coerce_to_points(geom(spark, [(0, 0)], [(2, 4)]), "multipoint")) == (1.0, 2.0)
    with pytest.raises(ValueError):
        coerce_to_points(ell, "polygon", mode="line_midpoint")


def test_tessellations_index_every_point(spark):
    p = points(spark, cloud(60))
    for method in ("voronoi", "triangles", "square", "hex"):
        cells, index = tessellate.build_tessellation(p, method, 20)
        assert index.count() == 60 and cells.count() > 1
    with pytest.raises(ValueError):
        tessellate.build_tessellation(p, "other")
    assert tessellate.clip_box(points(spark, [(1, 1), (1, 3)])) == (0.9, 1.1, 0.9, 3.1)


def test_seeds_and_levels(spark):
    ring = np.array([[0, 0], [10, 0], [0, 10]], float)
    s = tessellate.random_seeds(spark, ring, 30)
    assert s.count() == 30 and s.where(F.col("x") + F.col("y") > 10).count() == 0
    xy = np.vstack([cloud(25, i, 4.0) + c for i, c in enumerate(([0, 0], [100, 0], [0, 100]))])
    best, table = tessellate.optimal_levels(points(spark, xy), max_levels=6)
    assert 3 in best and len(table) == 6


def test_comparisons(spark):
    rng = np.random.default_rng(4)
    xy, a = cloud(50), rng.normal(size=50)
    p = points(spark, xy, a=a.tolist(), z=(2 * a + rng.normal(size=50) * 0.1).tolist())
    rows = cv.compare_models_cv(p, "z", ["a"], ("GWR", "RF", "none"), random_folds(p, 3), options={"GWR": {"bandwidth": 30}, "RF": {"trees": 10}})
    assert [r["model"] for r in rows] == ["GWR", "RF"] and all(r["R2"] > 0.3 for r in rows)
    fits = {"OLS": models.fit_ols(p, "z", ["a"])}
    assert cv.compare_models(fits)[0]["R2"] > 0.9
    assert abs(cv.residual_morans(fits)[0]["I"]) < 0.5
