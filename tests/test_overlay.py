"""Polygon overlay, repair, buffers, clip targets, and tessellations of boundaries of any shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.functions.exprs import shoelace
from terrastat.operators import tessellate
from terrastat.operators.joins import polygon_matches
from terrastat.operators.overlay import RULES, buffer, buffered, clip_cells, dissolve, holds, make_valid, overlay, repaired, signed_area, structs
from terrastat.operators.polygons import grid_polygons, polygon_pieces

U = [np.array([[0, 0], [10, 0], [10, 10], [7, 10], [7, 3], [3, 3], [3, 10], [0, 10]], float)]
BOX = "cell_id long, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"


def square(x, y, a, b=None):
    b = a if b is None else b
    return np.array([[x, y], [x + a, y], [x + a, y + b], [x, y + b]], float)


def layer(spark, shapes, id_name="cell_id"):
    rows = [(i + 1, structs(s), *np.vstack(s).min(0).tolist(), *np.vstack(s).max(0).tolist()) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, BOX).withColumnRenamed("cell_id", id_name)


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")


def test_overlay_against_points():
    rng = np.random.default_rng(7)
    for k in range(60):
        p = [rng.random((rng.integers(3, 9), 2)) for _ in range(rng.integers(1, 3))]
        q = [rng.random((rng.integers(3, 9), 2))]
        if k % 3 == 0:  # shared edges and vertices
            p, q = [np.round(r * 4) / 4 for r in p], [np.round(r * 4) / 4 for r in q]
        at = rng.random((300, 2)) * 1.1 - 0.05
        in_p, in_q = holds(at, p), holds(at, q)
        area = {}
        for how, rule in RULES.items():
            out = overlay(p, q, how)
            assert (holds(at, out) == rule(in_p, in_q)).all()
            area[how] = signed_area(out)
        assert area["union"] == pytest.approx(area["intersection"] + area["symmetric"], abs=1e-9)
    assert overlay(U, []) == [] and overlay([], []) == [] and signed_area(overlay(U, [], "union")) == pytest.approx(72)
    with pytest.raises(KeyError):
        overlay(U, U, "other")


def test_make_valid():
    bow = make_valid([np.array([[0, 0], [2, 2], [2, 2], [2, 0], [0, 2], [0, 0]], float)])
    assert len(bow) == 2 and signed_area(bow) == pytest.approx(2)
    ring = make_valid([square(0, 0, 4)[::-1], square(1, 1, 2)])  # wound either way, the hole turns clockwise
    assert sorted(round(signed_area([r]), 9) for r in ring) == [-4.0, 16.0]
    assert make_valid([np.array([[0, 0], [1, 1], [0, 0]], float)]) == [] and make_valid([np.array([[0, 0], [math.nan, 1], [1, 0]])]) == []


def test_touching_parts_are_rings_of_their_own():
    parts = overlay([square(0, 0, 1)], [square(1, 1, 1)], "union")
    assert len(parts) == 2
    frame = overlay([square(0, 0, 3)], [square(1, 1, 1)], "difference")
    assert len(frame) == 2 and signed_area(frame) == pytest.approx(8)


@pytest.mark.parametrize("n,r", [(3, 0.3), (7, 1.0), (12, 2.5)])
def test_buffers_of_convex_rings(n, r):
    t = np.sort(np.random.default_rng(n).random(n)) * 2 * np.pi
    ring = np.column_stack([5 * np.cos(t), 5 * np.sin(t)])
    edge = np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()
    want = signed_area([ring]) + edge * r + math.pi * r * r
    assert signed_area(buffer([ring], r)) == pytest.approx(want, rel=1e-3)


def test_buffers_of_a_concave_ring():
    rng = np.random.default_rng(2)
    at = rng.random((1500, 2)) * 18 - 4

    def distance(rings):
        out = np.full(len(at), np.inf)
        for ring in rings:
            for a, b in zip(ring, np.roll(ring, -1, 0)):
                t = np.clip((at - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                out = np.minimum(out, np.hypot(*(at - a - t[:, None] * (b - a)).T))
        return out

    away, inside = distance(U), holds(at, U)
    for r in (0.5, 1.9, 2.5):  # 2.5 closes the notch
        grown = holds(at, buffer(U, r))
        assert (grown == (inside | (away <= r)))[np.abs(away - r) > 0.01].all()
    for r in (0.5, 1.2, 1.6):
        shrunk = holds(at, buffer(U, -r))
        assert (shrunk == (inside & (away >= r)))[np.abs(away - r) > 0.01].all()
    assert buffer(U, -3) == [] and buffer([], 2) == []


def test_cells_of_a_notched_boundary(spark):
    """A boundary that enters a cell twice: two rings, and the notch belongs to no cell."""
    cells = clip_cells(layer(spark, [[square(0, 0, 10, 4)], [square(0, 4, 10, 8)], [square(4, 5, 2, 2)], [square(20, 20, 1)]]), U)
    got = {r.cell_id: r for r in cells.select("cell_id", F.size("rings").alias("n"), F.abs(shoelace("rings")).alias("a")).collect()}
    assert set(got) == {1, 2} and got[2].n == 2 and got[2].a == pytest.approx(36) and got[1].a == pytest.approx(36)
    held = {r.row_id for r in polygon_matches(points(spark, [(5, 5), (1, 9), (9, 9), (5, 3.5), (5, 2)]), cells).collect()}
    assert held == {1, 2, 4}
    with_hole = clip_cells(layer(spark, [[square(0, 0, 10)]]), [square(-5, -5, 30), square(2, 2, 3)])
    assert with_hole.select(F.abs(shoelace("rings"))).first()[0] == pytest.approx(91)
    hexes = grid_polygons(spark, U, target=30, kind="hex")
    assert hexes.agg(F.sum(F.abs(shoelace("rings")))).first()[0] == pytest.approx(72)


def test_layers_of_unequal_rings(spark):
    shapes = [U, [square(0, 0, 4), square(1, 1, 2)], [np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)]]
    df = layer(spark, shapes, "row_id").withColumn("name", F.lit("x"))
    df = df.unionByName(df.where("row_id = 1").withColumn("row_id", F.lit(9).cast("long")).withColumn("rings", F.lit(None).cast(df.schema["rings"].dataType)))
    fixed = {r.row_id: r for r in repaired(df).select("row_id", "name", "xmin", F.size("rings").alias("n"), shoelace("rings").alias("a")).collect()}
    assert [fixed[k].n for k in (1, 2, 3, 9)] == [1, 2, 2, 0] and fixed[9].xmin is None and fixed[1].name == "x"
    assert [fixed[k].a for k in (1, 2, 3)] == pytest.approx([72, 12, 2])
    grown = {r.row_id: r.a for r in buffered(df, 0.5).select("row_id", shoelace("rings").alias("a")).collect()}
    assert grown[1] == pytest.approx(signed_area(buffer(U, 0.5)))
    pieces = polygon_pieces(df.where("row_id < 9"), layer(spark, [[square(0, 4, 20)]]))
    assert [(r.feature_id, r.n, r.area) for r in pieces.select("feature_id", F.size("rings").alias("n"), "area").collect()] == [(1, 2, pytest.approx(36))]


def test_dissolve(spark):
    shapes = [[square(x, y, 3)] for x in range(0, 20, 2) for y in range(0, 6, 2)] + [[square(40, 40, 2)]]
    df = layer(spark, shapes).withColumn("grp", F.when(F.col("cell_id") > 15, 2).otherwise(1))
    whole = dissolve(df).select(F.size("rings").alias("n"), shoelace("rings").alias("a")).collect()
    assert [(r.n, round(r.a, 6)) for r in whole] == [(2, 21 * 7 + 4.0)]
    parts = {r.grp: r.a for r in dissolve(df, "grp", tile=2.5).select("grp", shoelace("rings").alias("a")).collect()}
    assert parts[1] == pytest.approx(11 * 7) and parts[2] == pytest.approx(11 * 7 + 4)
    assert dissolve(df.limit(0)).count() == 0


def test_clip_targets(spark):
    p = points(spark, [(0, 0), (10, 0), (10, 20)])
    assert signed_area(tessellate.clip_target(p)) == pytest.approx(200)
    assert signed_area(tessellate.clip_target(p, expand=0.1)) == pytest.approx(200 + 60 * 2 + math.pi * 4, rel=1e-3)
    assert signed_area(tessellate.clip_target(p, U, -0.5)) == pytest.approx(signed_area(buffer(U, -0.5)))
    line = tessellate.clip_target(points(spark, [(0, 0), (0, 1), (0, 30)]))
    assert len(line) == 2 and signed_area(line) == pytest.approx(1.5**2 * math.pi * 2 + 1 * 2 * 1.5, rel=0.05)
    assert len(tessellate.clip_target(points(spark, [(3, 3)]))) == 1
    with pytest.raises(ValueError):
        tessellate.clip_target(points(spark, []))


def test_voronoi_in_any_boundary(spark):
    xy = np.random.default_rng(4).random((40, 2)) * 10
    p = points(spark, np.vstack([xy, xy[:3]]))
    cells, index = tessellate.create_voronoi(p, U)
    assert cells.agg(F.sum(F.abs(shoelace("rings")))).first()[0] == pytest.approx(72) and index.count() == 43
    hulled, _ = tessellate.create_voronoi(p)
    hull = tessellate.convex_hull(xy)
    wide = 0.02 * math.hypot(*np.ptp(hull, axis=0))
    assert hulled.count() == 40 and hulled.agg(F.sum(F.abs(shoelace("rings")))).first()[0] == pytest.approx(signed_area(buffer([hull], wide)))
    whole, _ = tessellate.create_voronoi(p, U, expand=1.0, clip=False)
    assert whole.agg(F.sum(F.abs(shoelace("rings")))).first()[0] == pytest.approx(144)
    assert tessellate.create_voronoi(points(spark, [(1, 1), (1, 1)]), keep_duplicates=True)[0].count() == 1


def test_voronoi_without_sending_the_seeds(spark):
    rng = np.random.default_rng(8)
    xy = np.vstack([rng.random((60, 2)) * 100, rng.normal(50, 0.5, (60, 2))])  # a dense cluster among sparse seeds
    box = square(0, 0, 100)
    sent = {r.cell_id: r.a for r in tessellate.voronoi_cells(points(spark, xy), box).select("cell_id", shoelace("rings").alias("a")).collect()}
    spread = {r.cell_id: r.a for r in tessellate.voronoi_cells(points(spark, xy), box, max_sent=0, first=4).select("cell_id", shoelace("rings").alias("a")).collect()}
    assert sent.keys() == spread.keys() and all(spread[k] == pytest.approx(sent[k], abs=1e-6) for k in sent)


def test_edges_that_nearly_coincide_are_not_copied(monkeypatch):
    """Three parts of a layer whose seams differ by less than the grid: each round of noding made up to 50 times as many edges."""
    from terrastat.operators import overlay as O

    seam, off = 178.18277321655125, 178.18277321662754
    parts = [
        [[65.0, seam], [off, seam], [off, 356.3655464331788]],
        [[48.0, 943.0000000000842], [60.0, 943.0000000000842], [60.0, 1052.0000000000841]],
        [[seam, off], [seam, 41.0], [189.99999999992372, 12.0], [219.99999999992372, off]],
    ]
    most, cuts = [], O._cuts

    def counted(segments, slack):
        most.append(len(segments))
        assert len(segments) < 100
        return cuts(segments, slack)

    monkeypatch.setattr(O, "_cuts", counted)
    parts = [[np.array(p)] for p in parts]
    whole = O.union_all(parts)
    assert most and np.isclose(O.signed_area(whole), sum(abs(O.signed_area(p)) for p in parts), rtol=0, atol=1e-6)
