"""Polygon layers: clipping to a boundary, overlaps of polygons, hulls and buffers.

Candidates meet in bins by equi-joins; the geometry of a pair or of a cell is numpy inside tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import shoelace
from .assign import with_cell_id
from .dealing import dealt
from .joins import _bin
from .overlay import clip_cells, common, common_convex, convex, make_valid, overlay, packed, signed_area, structs, unpacked
from .tessellate import clip_convex, convex_hull, grid_size, hex_grid, square_grid

SENT_CELLS = 1_000  # cells that go to every task
PAIR = "feature_id long, cell_id long, overlap double, meets boolean"
PIECES = "feature_id long, cell_id long, rings array<array<struct<x:double,y:double>>>, area double"


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether points lie in an even-odd polygon or on its edges."""
    odd, on = np.zeros(len(points), bool), np.zeros(len(points), bool)
    x, y = points[:, :1], points[:, 1:]
    for ring in rings:
        a, b = ring, np.roll(ring, -1, 0)
        (ax, ay), (bx, by) = a.T, b.T
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on |= ((cross == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))).any(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= (((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).sum(1) % 2 == 1
    return odd | on


def _edges_cross(p: list[np.ndarray], q: list[np.ndarray]) -> bool:
    a, b = np.vstack(p), np.vstack([np.roll(r, -1, 0) for r in p])
    c, d = np.vstack(q), np.vstack([np.roll(r, -1, 0) for r in q])
    side = lambda o, t, z: np.sign((t[:, None, 0] - o[:, None, 0]) * (z[None, :, 1] - o[:, None, 1]) - (t[:, None, 1] - o[:, None, 1]) * (z[None, :, 0] - o[:, None, 0]))
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0).T).any())


def overlap_area(p: list[np.ndarray], q: list[np.ndarray]) -> float:
    """Area common to two simple polygons, holes wound the other way: signed sums over fans of triangles, which are
    convex, so that each pair of them is clipped exactly."""
    def fans(rings, origin):
        for ring in rings:
            for a, b in zip(ring - origin, np.roll(ring, -1, 0) - origin, strict=True):
                turn = a[0] * b[1] - a[1] * b[0]
                if turn:
                    yield np.array([[0.0, 0.0], a, b] if turn > 0 else [[0.0, 0.0], b, a]), np.sign(turn)

    a, b = convex(p), convex(q)
    if a is not None and b is not None:
        met = common_convex(a, b)
        return max(0.0, ring_area(np.array(met) - met[0])) if len(met) > 2 else 0.0
    origin = q[0].mean(0)
    mine, theirs = list(fans(p, origin)), list(fans(q, origin))
    total = sum(s * t * ring_area(c) for a, s in mine for b, t in theirs if len(c := clip_convex(a, b)) > 2)
    turn = np.sign(sum(map(ring_area, p))) * np.sign(sum(map(ring_area, q)))
    return max(0.0, float(total * (turn or 1)))


def _box_pairs(features: DataFrame, cells: DataFrame, bin_width: float | None = None) -> DataFrame:
    """``f_id, f_xy, f_sizes, c_id, c_xy, c_sizes`` of features and cells whose boxes meet.  Boxes are binned; a pair comes from the one bin
    that holds the corner both boxes share.  Few cells go to all tasks, and features are dealt over them; more meet them by
    bins."""
    side, n = cells.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))), F.count(F.lit(1))).first()
    if bin_width is None:
        bin_width = side or 1.0
    few = n <= SENT_CELLS

    def binned(df, id_col, mark):
        out = df.select(F.col(id_col).alias(f"{mark}id"), F.col("rings").alias(f"{mark}rings"), *[F.col(c).alias(f"{mark}{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
        for axis in "xy":
            out = out.withColumn(f"__b{axis}", F.explode(F.sequence(_bin(F.col(f"{mark}{axis}min"), bin_width), _bin(F.col(f"{mark}{axis}max"), bin_width))))
        return out

    if few:
        met = binned(dealt(features), "row_id", "f_").join(F.broadcast(binned(cells, "cell_id", "c_")), ["__bx", "__by"])
    else:
        met = dealt(binned(features, "row_id", "f_"), "__bx", "__by").join(dealt(binned(cells, "cell_id", "c_"), "__bx", "__by"), ["__bx", "__by"])
    for axis in "xy":
        low = F.greatest(F.col(f"f_{axis}min"), F.col(f"c_{axis}min"))
        met = met.where((low <= F.least(F.col(f"f_{axis}max"), F.col(f"c_{axis}max"))) & (_bin(low, bin_width) == F.col(f"__b{axis}")))
    return met.select("f_id", *packed(F.col("f_rings"), "f_"), "c_id", *packed(F.col("c_rings"), "c_"))


def _pairs_of(f: pd.DataFrame):
    for i, p, m, j, q, n in zip(f["f_id"], f["f_xy"], f["f_sizes"], f["c_id"], f["c_xy"], f["c_sizes"], strict=True):
        yield i, unpacked(p, m), j, unpacked(q, n)


def polygon_pieces(features: DataFrame, cells: DataFrame, how: str = "intersection", bin_width: float | None = None) -> DataFrame:
    """``feature_id, cell_id, rings, area``: what polygon features (``row_id, rings, xmin, ymin, xmax, ymax``) and cells that
    meet have in common, each part with rings of its own; pairs without common area drop out.  Other ``how`` of
    ``overlay`` are formed for the pairs whose boxes meet."""

    def run(frames):
        valid = {}  # few cells come again and again
        for f in frames:
            out = []
            for i, p, j, q in _pairs_of(f):
                if how == "intersection":
                    key = (j, len(q), q[0].tobytes() if q else b"")
                    if key not in valid:
                        if len(valid) > 1000:
                            valid.clear()
                        valid[key] = make_valid(q)
                    rings = common(p, valid[key])
                else:
                    rings = overlay(p, q, how)
                if rings:
                    out.append((i, j, structs(rings), signed_area(rings)))
            yield pd.DataFrame(out, columns=["feature_id", "cell_id", "rings", "area"])

    return _box_pairs(features, cells, bin_width).mapInPandas(run, PIECES)


def polygon_overlaps(features: DataFrame, cells: DataFrame, bin_width: float | None = None) -> DataFrame:
    """``feature_id, cell_id, overlap, meets`` of polygon features (``row_id, rings, xmin, ymin, xmax, ymax``) and cells whose
    closed polygons meet."""

    def run(frames):
        for f in frames:
            out = []
            for i, p, j, q in _pairs_of(f):
                area = overlap_area(p, q)
                meets = area > 0 or bool(_inside(np.vstack(p), q).any() or _inside(np.vstack(q), p).any()) or _edges_cross(p, q)
                out.append((i, j, area, meets))
            yield pd.DataFrame(out, columns=["feature_id", "cell_id", "overlap", "meets"])

    return _box_pairs(features, cells, bin_width).mapInPandas(run, PAIR).where("meets")


def assign_polygons(features: DataFrame, cells: DataFrame, id_col=None, keep_unassigned: bool = False, largest: bool = True, tie_break: str = "smallest") -> DataFrame:
    """``features`` with ``cell_id``: the cell of the largest overlap, or without ``largest`` the smallest that meets the
    feature; ties by the lower id.  ``tie_break="first"`` takes the lowest id of those that meet."""
    cells = with_cell_id(cells, id_col)
    met = polygon_overlaps(features, cells)
    if largest:
        key = F.struct((-F.round("overlap", 9)).alias("k"), "cell_id")
    elif tie_break == "smallest":
        met = met.join(cells.select("cell_id", F.round(F.abs(shoelace("rings")), 9).alias("k")), "cell_id")
        key = F.struct("k", "cell_id")
    else:
        key = F.struct("cell_id")
    best = met.groupBy(F.col("feature_id").alias("row_id")).agg(F.min(key).alias("m")).select("row_id", F.col("m.cell_id").alias("cell_id"))
    return features.join(best, "row_id", "left" if keep_unassigned else "inner")


def grid_polygons(spark, boundary: list[np.ndarray], target: int | None = None, kind: str = "square", cellsize: float | tuple | None = None, n: int | tuple | None = None, clip: bool = True) -> DataFrame:
    """Square or hexagonal cells over a boundary: a given cell size wins over counts, counts over a target number.  Cells are
    clipped to the boundary unless ``clip`` is false, and numbered from 1 row by row after that."""
    flat = np.vstack([np.asarray(r, float) for r in boundary])
    (x0, y0), (x1, y1) = flat.min(0), flat.max(0)
    if cellsize is not None:
        sx, sy = cellsize if isinstance(cellsize, tuple) else (cellsize, cellsize)
        nx, ny = max(1, int(np.ceil((x1 - x0) / sx - 1e-12))), max(1, int(np.ceil((y1 - y0) / sy - 1e-12)))
    else:
        nx, ny = (n if isinstance(n, tuple) else (n, n)) if n is not None else grid_size(x1 - x0, y1 - y0, target or 100, kind)
        sx, sy = (x1 - x0) / nx, (y1 - y0) / ny
    cells = hex_grid(spark, (x0, x1, y0, y1), sx) if kind == "hex" else square_grid(spark, (x0, x0 + nx * sx, y0, y0 + ny * sy), nx, ny)
    if clip:
        cells = clip_cells(cells, boundary)
        cells = cells.withColumn("cell_id", F.row_number().over(Window.orderBy("cell_id")).cast("long"))  # cells, not points
    return cells


def hull(points: DataFrame) -> np.ndarray:
    """The convex hull of a layer: each task's own hull, then the hull of those."""
    def run(frames):
        kept = np.zeros((0, 2))
        for f in frames:
            kept = convex_hull(np.vstack([kept, f[["x", "y"]].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    rows = points.select("x", "y").mapInPandas(run, "x double, y double").toPandas().to_numpy(float)  # corners of hulls
    return convex_hull(rows)


def buffered_hull(corners: np.ndarray, distance: float, segments: int = 30) -> np.ndarray:
    """A convex ring grown by a distance, its corners rounded with ``segments`` steps a quadrant."""
    t = np.arange(4 * segments) * (np.pi / 2 / segments)
    around = distance * np.column_stack([np.cos(t), np.sin(t)])
    return convex_hull((np.asarray(corners, float)[:, None, :] + around[None]).reshape(-1, 2))
