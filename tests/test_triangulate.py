"""Delaunay triangles against brute force, areas and the one-task version."""

import itertools

import numpy as np
import pandas as pd
import pytest

from terrastat.operators import neighbours, tessellate, triangulate


def layer(spark, xy, ids=None):
    xy = np.asarray(xy, float)
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(xy)) if ids is None else ids, "x": xy[:, 0], "y": xy[:, 1]}))


def triangles(spark, xy, **given):
    rows = triangulate.delaunay_triangles(layer(spark, xy), **given).collect()
    assert len({(r.a, r.b, r.c) for r in rows}) == len(rows)
    return rows


def area(rows):
    p = np.array([[[c["x"], c["y"]] for c in r.rings[0]] for r in rows])
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    twice = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    assert (twice > 0).all()
    return twice.sum() / 2


def hull_area(xy):
    ring = tessellate.convex_hull(np.asarray(xy, float))
    return abs((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum()) / 2


def brute(xy):
    """Triples whose circle holds no point."""
    out = set()
    for t in itertools.combinations(range(len(xy)), 3):
        p = xy[list(t)]
        if np.cross(np.append(p[1] - p[0], 0), np.append(p[2] - p[0], 0))[2] < 0:
            p = p[::-1]
        d = p[:, None] - xy[None]
        det = np.linalg.det(np.concatenate([d, (d**2).sum(2, keepdims=True)], 2).transpose(1, 0, 2))
        det[list(t)] = 0
        if (det <= 1e-12).all():
            out.add(t)
    return out


def test_equals_brute_force(spark):
    xy = np.random.default_rng(5).random((40, 2))
    assert {(r.a, r.b, r.c) for r in triangles(spark, xy, first=4)} == brute(xy)


def test_equals_the_version_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SENT_ROWS", 0)  # as layers of more rows are searched
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.random((300, 2)), 0.5 + 1e-3 * rng.normal(size=(900, 2))])  # most of them in one spot
    rows = triangles(spark, xy)
    assert area(rows) == pytest.approx(hull_area(xy), rel=1e-9)
    one = {tuple(sorted(t)) for t in tessellate.delaunay(xy).tolist()}
    many = {(r.a, r.b, r.c) for r in rows}
    assert one <= many and len(many - one) < 5  # slivers along the hull, which far corners of one big triangle hide


def test_points_on_circles_and_lines(spark):
    grid = np.array([(x, y) for x in range(7) for y in range(6)], float)
    t = np.arange(24) * np.pi / 12
    xy = np.vstack([grid, [3, 2.5] + 10 * np.column_stack([np.cos(t), np.sin(t)])])
    rows = triangles(spark, xy)
    assert len(rows) == 2 * len(xy) - 24 - 2 and area(rows) == pytest.approx(hull_area(xy))
    assert sum(max(r.a, r.b, r.c) < len(grid) for r in rows) == 2 * 6 * 5
    assert triangles(spark, [(k, 2 * k) for k in range(9)]) == []
    assert triangles(spark, [(0, 0), (1, 1)]) == [] and triangles(spark, [(0, 0), (1, 1), (np.nan, 2)]) == []
    assert triangulate.delaunay_triangles(layer(spark, np.zeros((1, 2))).limit(0)).count() == 0


def test_cells_of_triangles(spark):
    xy = np.random.default_rng(8).random((80, 2))
    edge = np.array([[0.2, 0.2], [0.8, 0.2], [0.8, 0.8], [0.2, 0.8]])
    cells, index = tessellate.build_tessellation(layer(spark, xy), "triangles", boundary=edge)
    assert sum(r.a for r in cells.select(tessellate.shoelace("rings").alias("a")).collect()) == pytest.approx(0.36)
    assert sorted(r.cell_id for r in cells.collect()) == list(range(1, cells.count() + 1))
    inside = ((xy > 0.2) & (xy < 0.8)).all(1)
    assert index.where("cell_id is not null").count() >= inside.sum()
    with pytest.raises(ValueError, match="three points"):
        tessellate.build_tessellation(layer(spark, xy[:2]), "triangles")
