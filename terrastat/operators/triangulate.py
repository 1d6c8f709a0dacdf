"""Delaunay triangles of layers of any size.

Each point keeps its own star, the triangles around it, made from a few candidates.  A star is right when no circle through its
triangles holds a point, so circles' centres look for their nearest points by ``knn_join``, and stars whose circles hold one
take it as a candidate and are made again.  Rounds go on until no circle holds a point; only stars that changed take part.
Work and memory of a task do not depend on the number of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .neighbours import knn_join
from .tessellate import CELL, _cell_row

SHAKE = 1e-10  # of the layer's extent: points are moved so far for comparisons, so that no four are on a circle
FLAT = 1e-15  # of the extent's square: triangles of three points in a line have no more area
HULL_ROWS = 1_000_000  # corners of the hull that go to every task, 40 bytes each
ROWS_AT_ONCE = 2000

_STAR = "row_id long, x double, y double, ox double, oy double, ids array<long>, xy array<double>, tri array<long>, circles array<double>, fresh boolean"


def star(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles, open ends) around the origin among the points ``b``, as pairs of their numbers counter-clockwise.

    The inversion x / |x|^2 turns circles through the origin into lines, and those that hold no point into the lines along
    the hull of the inverted points and the origin.  An open end is an edge (origin, point) of the outer hull: (k, -1) has all
    points on its right, (-1, k) on its left.
    """
    inv = np.vstack([b / (b * b).sum(1)[:, None], [[0.0, 0.0]]])
    order = np.lexsort((inv[:, 1], inv[:, 0]))

    def half(seq):
        out: list[int] = []
        for q in seq:
            while len(out) > 1:
                (ax, ay), (px, py), (qx, qy) = inv[out[-2]], inv[out[-1]], inv[q]
                if (px - ax) * (qy - ay) - (py - ay) * (qx - ax) > 0:
                    break
                out.pop()
            out.append(q)
        return out[:-1]

    ring = np.array(half(order.tolist()) + half(order[::-1].tolist()))
    if len(ring) < 2:
        return np.zeros((0, 2), int), np.zeros((0, 2), int)
    pairs = np.column_stack([ring, np.roll(ring, -1)])
    pairs[pairs == len(b)] = -1
    ends = (pairs == -1).any(1)
    return pairs[~ends], pairs[ends]


def _circles(b: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre, as seen from the origin, and radius of the circles through the origin and pairs of points."""
    p, q = b[tri[:, 0]], b[tri[:, 1]]
    twice = 2 * (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0])
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.column_stack([(q[:, 1] * pp - p[:, 1] * qq) / twice, (p[:, 0] * qq - q[:, 0] * pp) / twice])
    return np.column_stack([c, np.hypot(c[:, 0], c[:, 1])])


def _closed(me, ids, xy, hull_ids, hull_xy):
    """A star whose open ends no corner of the hull lies beyond: (candidates' ids, their places, triangles, circles)."""
    while True:
        b = xy[:, :2] - me
        tri, ends = star(b)
        more = set()
        for k, m in ends.tolist():
            d = b[k] if m == -1 else -b[m]
            side = (hull_xy[:, :2] - me) @ np.array([d[1], -d[0]])  # positive for all candidates
            at = int(np.argmin(side))
            if side[at] < 0 and hull_ids[at] not in ids:
                more.add(at)
        if not more:
            return ids, xy, tri, _circles(b, tri)
        add = sorted(more)
        ids, xy = np.concatenate([ids, hull_ids[add]]), np.vstack([xy, hull_xy[add]])


def _stars(hull):
    def run(frames):
        hull_ids, hull_xy = hull.value
        for whole in frames:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                out = []
                for r in whole.iloc[at : at + ROWS_AT_ONCE].itertuples():
                    me = np.array([r.x, r.y])
                    ids, xy = np.asarray(r.ids, np.int64), np.asarray(r.xy, float).reshape(-1, 4)
                    new, places = np.asarray(r.new_ids, np.int64), np.asarray(r.new_xy, float).reshape(-1, 4)
                    known = np.isin(new, ids)
                    before = ids
                    ids, xy = np.concatenate([ids, new[~known]]), np.vstack([xy, places[~known]])
                    ids, xy, tri, circles = _closed(me, ids, xy, hull_ids, hull_xy)
                    good = np.isfinite(circles).all(1)
                    # what is in no triangle of the star is in none of the final one: candidates do not pile up
                    used = np.unique(tri[good]) if len(tri) else np.arange(0)
                    keep = used if len(used) else np.arange(len(ids))
                    fresh = set(ids[keep].tolist()) != set(before.tolist())
                    seat = np.full(len(ids), -1)
                    seat[keep] = np.arange(len(keep))
                    circles = circles[good] + np.array([r.x, r.y, 0.0])
                    out.append((r.row_id, r.x, r.y, r.ox, r.oy, ids[keep], xy[keep].ravel(), seat[tri[good]].ravel(), circles.ravel(), fresh))
                yield pd.DataFrame(out, columns=["row_id", "x", "y", "ox", "oy", "ids", "xy", "tri", "circles", "fresh"])

    return run


def _hull(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places (``x, y, ox, oy``) of the hull's corners: each task's own hull, then the hull of those."""
    from .tessellate import convex_hull

    def corners(f: pd.DataFrame) -> pd.DataFrame:
        ring = pd.DataFrame(convex_hull(f[["x", "y"]].to_numpy(float)), columns=["x", "y"])
        return f.merge(ring, on=["x", "y"])[list(f.columns)]

    def run(frames):
        kept = None
        for f in frames:
            kept = corners(f if kept is None else pd.concat([kept, f]))
        if kept is not None:
            yield kept

    rows = cut_lineage(seeds.select("row_id", "x", "y", "ox", "oy").mapInPandas(run, "row_id long, x double, y double, ox double, oy double"))
    if rows.count() > HULL_ROWS:
        raise ValueError(f"the layer's hull has more than {HULL_ROWS} corners")
    f = corners(rows.toPandas())
    return f["row_id"].to_numpy(np.int64), f[["x", "y", "ox", "oy"]].to_numpy(float)


def _gathered(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``row_id, new_ids, new_xy`` of the candidates ``i, j``."""
    at = pairs.select("i", "j").join(seeds.select(F.col("row_id").alias("j"), "x", "y", "ox", "oy"), "j")
    found = at.groupBy("i").agg(F.collect_list(F.struct("j", "x", "y", "ox", "oy")).alias("m"))
    return found.select(F.col("i").alias("row_id"), F.col("m.j").alias("new_ids"), F.flatten(F.transform("m", lambda e: F.array(e["x"], e["y"], e["ox"], e["oy"]))).alias("new_xy"))


def delaunay_triangles(points: DataFrame, first: int = 20) -> DataFrame:
    """``a, b, c`` (ids, ascending) and ``rings``, ``xmin`` to ``ymax`` of the Delaunay triangles of ``row_id, x, y``.

    Places are distinct (``dedup_points``), ids too; rows without finite coordinates take no part.  Four points on a circle are
    cut along either diagonal, the same at every run; points nearer to each other than 1e-9 of the extent may be cut as if moved
    by so much.  Points in a line, or fewer than three, have no triangles.  ``first`` is the number of neighbours a star
    begins with.
    """
    from ..functions.exprs import all_finite

    spark = points.sparkSession
    ok = points.where(all_finite(["x", "y"])).select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("double").alias("ox"), F.col("y").cast("double").alias("oy"))
    x0, x1, y0, y1, n = ok.agg(F.min("ox"), F.max("ox"), F.min("oy"), F.max("oy"), F.count(F.lit(1))).first()
    if n < 3 or not max(x1 - x0, y1 - y0) > 0:
        return spark.createDataFrame([], "a long, b long, c long, " + CELL.split(", ", 1)[1])
    span = max(x1 - x0, y1 - y0)

    def moved(column, salt):
        return F.col(column) + F.lit(SHAKE * span) * (F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5)

    seeds = cut_lineage(ok.select("row_id", moved("ox", 1).alias("x"), moved("oy", 2).alias("y"), "ox", "oy"))
    hull = spark.sparkContext.broadcast(_hull(seeds))
    none = [F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("xy")]
    start = seeds.select("*", *none).join(_gathered(knn_join(seeds, seeds, first, exclude_self=True), seeds), "row_id")
    todo, done = cut_lineage(start.mapInPandas(_stars(hull), _STAR)), None
    while True:
        corner = lambda k: F.get("ids", F.get("tri", 2 * F.col("k") + k).cast("int"))
        each = todo.where(F.size("tri") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("tri") / 2).cast("int") - 1)))
        each = each.select(F.sort_array(F.array("row_id", corner(0), corner(1))).alias("abc"), *[F.get("circles", 3 * F.col("k") + m).alias(c) for m, c in enumerate(("x", "y", "r"))])
        circles = cut_lineage(each.dropDuplicates(["abc"]).withColumn("row_id", F.monotonically_increasing_id()))
        near = knn_join(circles.select("row_id", "x", "y"), seeds, 4).withColumnRenamed("i", "row_id").join(circles, "row_id")
        within = F.col("d") < F.col("r") * (1 - 1e-14) - F.lit(1e-12 * span)
        held = near.where(within & ~F.array_contains("abc", F.col("j"))).select(F.explode("abc").alias("i"), "j").distinct()
        again = cut_lineage(todo.drop("tri", "circles", "fresh").join(_gathered(held, seeds), "row_id").mapInPandas(_stars(hull), _STAR))
        # a star that knew the points already differs by rounding only
        right = todo.join(again.where("fresh").select("row_id"), "row_id", "left_anti")
        done = right if done is None else done.unionByName(right)
        todo = again.where("fresh")
        if not todo.limit(1).count():
            break

    def rings(frames):
        for whole in frames:
            out = []
            for r in whole.itertuples():
                ids, xy = np.asarray(r.ids, np.int64), np.asarray(r.xy, float).reshape(-1, 4)
                for u, v in np.asarray(r.tri, int).reshape(-1, 2).tolist():
                    if r.row_id > min(ids[u], ids[v]):
                        continue  # it is in the star of its least id
                    ring = np.array([[r.ox, r.oy], xy[u, 2:], xy[v, 2:]])
                    p, q = ring[1] - ring[0], ring[2] - ring[0]
                    twice = p[0] * q[1] - p[1] * q[0]
                    if abs(twice) > FLAT * span * span:
                        a, b, c = sorted((int(r.row_id), int(ids[u]), int(ids[v])))
                        row = _cell_row(0, ring if twice > 0 else ring[::-1])
                        out.append((a, b, c, *[row[k] for k in ("rings", "xmin", "ymin", "xmax", "ymax")]))
            yield pd.DataFrame(out, columns=["a", "b", "c", "rings", "xmin", "ymin", "xmax", "ymax"])

    return cut_lineage(done.mapInPandas(rings, "a long, b long, c long, " + CELL.split(", ", 1)[1]))
