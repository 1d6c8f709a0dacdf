"""Tessellations: square and hexagonal grids, Voronoi cells, Delaunay triangles, seeds, stable ids."""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import shoelace

CELL = "cell_id long, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"
_grids: dict[str, DataFrame] = {}


def grid_size(width: float, height: float, target: int, kind: str = "square") -> tuple[int, int]:
    """Cells along x and y for about ``target`` cells; hexagons pack denser."""
    eff = target * (math.sqrt(3) / 2 if kind == "hex" else 1)
    nx = max(1, round(math.sqrt(eff * width / height)))
    return nx, max(1, round(math.ceil(eff / nx)))


def square_grid(spark: SparkSession, box, nx: int, ny: int) -> DataFrame:
    """Row-major rectangles of an even grid, ids from 1."""
    x0, x1, y0, y1 = box
    i = F.col("id")
    cx, cy, w, h = i % nx, F.floor(i / nx), (x1 - x0) / nx, (y1 - y0) / ny
    a, b, c, d = F.lit(x0) + cx * w, F.lit(y0) + cy * h, F.lit(x0) + (cx + 1) * w, F.lit(y0) + (cy + 1) * h
    ring = F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ((a, b), (c, b), (c, d), (a, d))])
    return spark.range(nx * ny).select((i + 1).alias("cell_id"), F.array(ring).alias("rings"), a.alias("xmin"), b.alias("ymin"), c.alias("xmax"), d.alias("ymax"))


def hex_grid(spark: SparkSession, box, size: float) -> DataFrame:
    """Pointy-top hexagons, ``size`` between opposite edges, rows size * sqrt(3) / 2 apart, odd rows shifted; ids row-major."""
    x0, x1, y0, y1 = box
    step = size * math.sqrt(3) / 2
    nx, ny = math.ceil((x1 - x0) / size) + 1, math.ceil((y1 - y0) / step) + 1
    i = F.col("id")
    row = F.floor(i / nx)
    cx, cy = F.lit(x0) + (i % nx) * size + (row % 2) * (size / 2), F.lit(y0) + row * step
    r = size / math.sqrt(3)
    corner = [(math.cos(math.radians(60 * k + 30)) * r, math.sin(math.radians(60 * k + 30)) * r) for k in range(6)]
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in corner])
    return spark.range(nx * ny).select((i + 1).alias("cell_id"), F.array(ring).alias("rings"), (cx - size / 2).alias("xmin"), (cy - r).alias("ymin"), (cx + size / 2).alias("xmax"), (cy + r).alias("ymax"))


def hex_cell_of(x, y, box, size: float):
    """The hexagon of a point, arithmetic only: the nearer of the two candidate row centres (ties: lower id)."""
    x0, x1, y0, _ = box
    step = size * math.sqrt(3) / 2
    nx = math.ceil((x1 - x0) / size) + 1
    low = F.floor((y - y0) / step)

    def near(row):
        i = F.greatest(F.lit(0), F.least(F.round((x - x0 - (row % 2) * (size / 2)) / size), F.lit(nx - 1)))
        dx, dy = x - (x0 + i * size + (row % 2) * (size / 2)), y - (y0 + row * step)
        return F.struct((dx * dx + dy * dy).alias("d"), (row * nx + i + 1).cast("long").alias("id"))

    return F.least(near(low), near(low + 1))["id"]


def clip_ring(ring: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a ring where a x + b y <= c (exact for convex rings)."""
    if not len(ring):
        return ring
    v = ring @ np.array([a, b]) - c
    out = []
    for p, q, s, t in zip(ring, np.roll(ring, -1, 0), v, np.roll(v, -1), strict=True):
        if s <= 0:
            out.append(p)
        if s * t < 0:
            out.append(p + (q - p) * (s / (s - t)))
    return np.array(out)


def clip_convex(ring: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """A ring cut by a convex, counter-clockwise ring."""
    for p, q in zip(clipper, np.roll(clipper, -1, 0), strict=True):
        d = q - p
        ring = clip_ring(ring, d[1], -d[0], d[1] * p[0] - d[0] * p[1])
    return ring


def convex_hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _cell_row(cell_id, ring):
    return {"cell_id": int(cell_id), "rings": [[{"x": float(x), "y": float(y)} for x, y in ring]], "xmin": ring[:, 0].min(), "ymin": ring[:, 1].min(), "xmax": ring[:, 0].max(), "ymax": ring[:, 1].max()}


def _cut(ring: np.ndarray, me: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The part of a ring that is no farther from ``me`` than from ``other``."""
    diff = other - me
    return clip_ring(ring - me, diff[0], diff[1], (diff @ diff) / 2) + me


def voronoi_cells(seeds: DataFrame, boundary: np.ndarray, max_sent: int = 50_000, first: int = 32) -> DataFrame:
    """Cells of ``row_id, x, y`` seeds inside a convex boundary, ``cell_id`` = seed id; seeds are distinct places.

    Up to ``max_sent`` seeds are broadcast, and each cell is the boundary cut by bisectors of ever farther seeds until
    none can reach it.  More seeds stay distributed, in blocks; cells are cut by their ``first`` nearest neighbours there,
    then by seeds of the other blocks that may reach them.
    """
    n = seeds.count()
    if n > max_sent:
        return _voronoi_by_blocks(seeds.select("row_id", "x", "y"), boundary, first)
    rows = [(r["row_id"], r["x"], r["y"]) for r in seeds.select("row_id", "x", "y").collect()]
    sent = seeds.sparkSession.sparkContext.broadcast(np.array([[x, y] for _, x, y in rows], float).reshape(-1, 2))

    def run(frames):
        all_ = sent.value
        for frame in frames:
            out = []
            for r in frame.itertuples():
                me, ring = np.array([r.x, r.y]), boundary
                d = ((all_ - me) ** 2).sum(1)
                for k in np.argsort(d, kind="stable"):
                    if d[k] == 0:
                        continue
                    if not len(ring) or d[k] > 4 * ((ring - me) ** 2).sum(1).max():
                        break
                    ring = _cut(ring, me, all_[k])
                if len(ring) >= 3:
                    out.append(_cell_row(r.row_id, ring))
            yield pd.DataFrame(out, columns=["cell_id", "rings", "xmin", "ymin", "xmax", "ymax"])

    return seeds.select("row_id", "x", "y").repartition(max(1, min(64, n // 200 + 1))).mapInPandas(run, CELL)


def _padded(rows) -> tuple[np.ndarray, np.ndarray]:
    """((rows, most, 2), counts) of flat lists of coordinates."""
    n = np.array([len(r) // 2 for r in rows], int)
    out = np.zeros((len(n), max(1, n.max(initial=0)), 2))
    if n.sum():
        out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate([np.asarray(r, float) for r in rows if len(r)]).reshape(-1, 2)
    return out, n


def _radius2(rings: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.arange(rings.shape[1]) < n[:, None], np.square(rings).sum(2), 0.0).max(1)


def _cut_rings(rings: np.ndarray, n: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``clip_ring`` for many rings at once, each around its own seed: the parts no farther from it than from ``other``."""
    at = np.arange(rings.shape[1])
    live = at < n[:, None]
    v = (rings * other[:, None]).sum(2) - (np.square(other).sum(1) / 2)[:, None]
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    w, q = np.take_along_axis(v, after, 1), np.take_along_axis(rings, after[:, :, None], 1)
    keep = np.zeros((len(n), len(at), 2), bool)
    keep[:, :, 0], keep[:, :, 1] = live & (v <= 0), live & (v * w < 0)
    cross = keep[:, :, 1]
    both = np.zeros((len(n), len(at), 2, 2))
    both[:, :, 0] = rings
    both[:, :, 1][cross] = rings[cross] + (q[cross] - rings[cross]) * (v[cross] / (v[cross] - w[cross]))[:, None]
    keep, size = keep.reshape(len(n), -1), keep.sum((1, 2))
    out = np.zeros((len(n), max(1, size.max(initial=0)), 2))
    out[np.arange(out.shape[1]) < size[:, None]] = both.reshape(len(n), -1, 2)[keep]
    return out, size


def _cut_nearest(rings: np.ndarray, n: np.ndarray, others: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rings, corners, which cut): rings around their seeds cut by ``many`` others each, sorted by distance, until none can reach."""
    used = np.zeros(others.shape[:2], bool)
    d2, r2 = np.square(others).sum(2), _radius2(rings, n)
    for k in range(others.shape[1]):
        rows = np.flatnonzero((k < many) & (d2[:, k] <= 4 * r2))
        if not len(rows):
            break
        part = rings[rows]
        reached = ((part * others[rows, k][:, None]).sum(2) > (d2[rows, k] / 2)[:, None]) & (np.arange(part.shape[1]) < n[rows][:, None])
        rows = rows[reached.any(1)]
        if not len(rows):
            continue
        cut, size = _cut_rings(rings[rows], n[rows], others[rows, k])
        if cut.shape[1] > rings.shape[1]:
            rings = np.pad(rings, ((0, 0), (0, cut.shape[1] - rings.shape[1]), (0, 0)))
        rings[rows, : cut.shape[1]], n[rows], used[rows, k] = cut, size, True
        r2[rows] = _radius2(cut, size)
    return rings, n, used


def _flat(rings: np.ndarray, n: np.ndarray) -> list:
    return [r[:k].ravel() for r, k in zip(rings, n, strict=True)]


_STATE = "row_id long, x double, y double, home int, ring array<double>, q2 double, open boolean"
_VISIT = "row_id long, x double, y double, ring array<double>, block int"


def _voronoi_by_blocks(seeds: DataFrame, boundary: np.ndarray, first: int) -> DataFrame:
    """Seeds are packed into blocks of equally many rows.  A cell is cut by its ``first`` nearest seeds of its own block, then
    by those of other blocks that are no farther.  A seed that cuts a cell is nearer to one of its corners than the cell's
    own: cells that wider seeds may reach meet the blocks about their corners twice, and last all blocks that hold a place
    nearer to a corner than its seed.  Rings are kept relative to their seeds; the number of rounds is fixed."""
    from .dealing import dealt, tasks_of
    from .lineage import cut_lineage
    from .neighbours import CELLS, blocked, spread_crowds

    spark = seeds.sparkSession
    places, boxes = blocked(seeds, ["x"], ["y"], "x", "y", "row_id")
    sent, tasks = spark.sparkContext.broadcast(boxes), tasks_of(spark)

    def near(me, home, rings, n, q2):
        """(row, block) of the other blocks within the rows' reach that hold a place nearer to a corner than its seed."""
        b = sent.value
        p, block = b.within(me[:, 0], me[:, 1], q2)
        keep = block != home[p]
        p, block = p[keep], block[keep]
        box = b.boxes.reshape(-1, 4)[block]
        met = np.zeros(len(p), bool)
        for k in range(rings.shape[1]):
            c = rings[p, k]
            met |= (k < n[p]) & (b.distance2(me[p, 0] + c[:, 0], me[p, 1] + c[:, 1], box) <= np.square(c).sum(1) * (1 + 1e-9))
        return p[met], block[met]

    def own(f):
        x, y, m = f["x"].to_numpy(float), f["y"].to_numpy(float), len(f)
        out, step = [], max(1, CELLS // m)
        for at in range(0, m, step):
            part = slice(at, at + step)
            me = np.column_stack([x[part], y[part]])
            rel = np.stack([x - x[part, None], y - y[part, None]], 2)
            d2 = np.square(rel).sum(2)
            d2[d2 == 0] = np.inf
            k = min(first, m)
            order = np.argpartition(d2, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d2, order, 1), axis=1), 1)
            d2 = np.take_along_axis(d2, order, 1)
            n = np.full(len(me), len(boundary))
            rings, n, _ = _cut_nearest(boundary - me[:, None], n, np.take_along_axis(rel, order[:, :, None], 1), np.isfinite(d2).sum(1))
            reach = 4 * _radius2(rings, n)
            q2 = np.minimum(reach, d2[:, -1])
            home = np.full(len(me), f["block"].iloc[0])
            open_ = reach > q2
            open_[near(me, home, rings, n, q2)[0]] = True
            out.append(pd.DataFrame({"row_id": f["row_id"].iloc[part].to_numpy(), "x": x[part], "y": y[part], "home": home, "ring": _flat(rings, n), "q2": q2, "open": open_}))
        return pd.concat(out)

    def visits(select):
        def run(frames):
            for f in frames:
                for at in range(0, len(f), 1024):
                    g = f.iloc[at : at + 1024]
                    rings, n = _padded(g["ring"])
                    p, block = select(g[["x", "y"]].to_numpy(float), g["home"].to_numpy(), rings, n, g["q2"].to_numpy(float))
                    yield g.iloc[p][["row_id", "x", "y", "ring"]].assign(block=block)

        return run

    def about_corners(me, home, rings, n, q2):
        p, k = np.nonzero(np.arange(rings.shape[1]) < n[:, None])
        c = rings[p, k]
        at = me[p] + c
        block = sent.value.surest(at[:, 0], at[:, 1])
        keep = sent.value.distance2(at[:, 0], at[:, 1], sent.value.boxes.reshape(-1, 4)[block]) <= np.square(c).sum(1)
        pair = np.unique(np.column_stack([p[keep], block[keep]]), axis=0)
        return pair[:, 0], pair[:, 1]

    def all_corners(me, home, rings, n, q2):
        p, k = np.nonzero(np.arange(rings.shape[1]) < n[:, None])
        c = rings[p, k]
        at = me[p] + c
        c, block = sent.value.within(at[:, 0], at[:, 1], np.square(c).sum(1) * (1 + 1e-9))
        pair = np.unique(np.column_stack([p[c], block]), axis=0)
        return pair[:, 0], pair[:, 1]

    def cutting(a, b):
        """The seeds of a block that cut the cells that visit it, relative to the cells' own."""
        out = []
        if len(a) and len(b):
            xy, step = b[["x", "y"]].to_numpy(float), max(1, CELLS // len(b))
            for at in range(0, len(a), step):
                g = a.iloc[at : at + step]
                rings, n = _padded(g["ring"])
                rel = xy - g[["x", "y"]].to_numpy(float)[:, None]
                d2 = np.square(rel).sum(2)
                most = np.full(d2.shape, -np.inf)
                for k in range(rings.shape[1]):
                    np.maximum(most, (rel * rings[:, k, None]).sum(2), out=most, where=(k < n)[:, None])
                d2[(most <= d2 / 2) | (d2 == 0)] = np.inf
                many = np.isfinite(d2).sum(1)
                order = np.argsort(d2, axis=1)[:, : max(1, many.max())]
                rel = np.take_along_axis(rel, order[:, :, None], 1)
                _, _, used = _cut_nearest(rings, n, rel, many)
                hit = used.any(1)
                if hit.any():
                    out.append(pd.DataFrame({"row_id": g["row_id"].to_numpy()[hit], "others": [r[u].ravel() for r, u in zip(rel[hit], used[hit], strict=True)]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["row_id", "others"], dtype=object)

    def shrunk(frames):
        for whole in frames:
            for at in range(0, len(whole), 1024):
                f = whole.iloc[at : at + 1024]
                rings, n = _padded(f["ring"])
                others, many = _padded([[] if o is None else o for o in f["others"]])
                d2 = np.where(np.arange(others.shape[1]) < many[:, None], np.square(others).sum(2), np.inf)
                rings, n, _ = _cut_nearest(rings, n, np.take_along_axis(others, np.argsort(d2, axis=1)[:, :, None], 1), many)
                yield f[["row_id", "x", "y", "home"]].assign(ring=_flat(rings, n), q2=f["q2"], open=4 * _radius2(rings, n) > f["q2"])

    def met(todo, select):
        made = cut_lineage(dealt(todo, "row_id").mapInPandas(visits(select), _VISIT))
        a, b = (side.repartition(tasks, "block", "__part").groupBy("block", "__part") for side in spread_crowds(made, places.select("x", "y", "block"), "row_id"))
        found = dealt(a.cogroup(b).applyInPandas(cutting, "row_id long, others array<double>"), "row_id")
        found = found.groupBy("row_id").agg(F.flatten(F.collect_list("others")).alias("others"))
        return cut_lineage(dealt(todo, "row_id").join(found, "row_id", "left").mapInPandas(shrunk, _STATE))

    state = cut_lineage(places.repartition(tasks, "block").groupBy("block").applyInPandas(own, _STATE))
    done = [state.where("not open")]
    state = met(state.where("open"), near)
    done.append(state.where("not open"))
    state = state.where("open")
    if state.limit(1).count():
        for select in (about_corners, about_corners, all_corners):
            state = met(state, select)
        done.append(state)

    def rows(frames):
        for f in frames:
            rings = [np.asarray(r).reshape(-1, 2) + (x, y) for r, x, y in zip(f["ring"], f["x"], f["y"], strict=True)]
            yield pd.DataFrame([_cell_row(i, r) for i, r in zip(f["row_id"], rings, strict=True) if len(r) >= 3], columns=["cell_id", "rings", "xmin", "ymin", "xmax", "ymax"])

    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return dealt(out.select("row_id", "x", "y", "ring")).mapInPandas(rows, CELL)


def create_voronoi(points: DataFrame, boundary: list | None = None, expand: float = 0.0, clip: bool = True, keep_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, index) of a point layer inside a boundary of any shape (rings); ``index`` is ``row_id, cell_id``.

    Without a boundary it is the points' hull grown by 2% of its box's diagonal (at least 0.02), so that outer cells are no
    slivers.  ``expand`` grows the boundary by a distance.  Without ``clip`` cells fill the boundary's box.  Points in one
    place make one cell; ``keep_duplicates`` keeps them in the graph, where they add nothing but work.
    """
    from ..sources.layer import dedup_points
    from .assign import point_cell_index
    from .overlay import buffer, clip_cells, make_valid
    from .polygons import hull

    if boundary is None:
        ring = hull(points)
        wide = 0.02 * max(math.hypot(*np.ptp(ring, axis=0)), 1.0)
        # one or two places have no hull with an area: a square around them
        boundary = buffer([ring], wide) if len(ring) > 2 else [_box_ring(*(ring.min(0) - wide), *(ring.max(0) + wide))]
    boundary = make_valid(boundary)
    if expand > 0:
        boundary = buffer(boundary, expand)
    flat = np.vstack(boundary)
    seeds = points.dropDuplicates(["x", "y"]) if keep_duplicates else dedup_points(points)
    seeds = seeds.select("row_id", "x", "y")
    corners = seeds.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    low, high = np.minimum(flat.min(0), corners[:2]), np.maximum(flat.max(0), corners[2:])
    cells = voronoi_cells(seeds, _box_ring(*low, *high))
    if clip:
        cells = clip_cells(cells, boundary)
    cells = stable_ids(cells).persist()
    return cells, point_cell_index(points, cells)


def _box_ring(x0, y0, x1, y1) -> np.ndarray:
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (index triples, counter-clockwise) of a few points in one task, by incremental insertion; points must be
    distinct.  ``triangulate.delaunay_triangles`` is for layers."""
    n = len(points)
    if n < 3:
        raise ValueError("a triangulation needs three points")
    span = np.ptp(points, axis=0).max() or 1.0
    mid = points.mean(0)
    big = mid + span * 1e3 * np.array([[0, 2], [-2, -1], [2, -1]])
    p = np.vstack([points, big])
    tri = {(n, n + 1, n + 2)}

    def inside(t, q):
        m = np.column_stack([p[list(t)] - q, ((p[list(t)] - q) ** 2).sum(1)])
        return np.linalg.det(m) > 0

    for i in range(n):
        bad = [t for t in tri if inside(t, p[i])]
        edges = [(t[k], t[(k + 1) % 3]) for t in bad for k in range(3)]
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        tri -= set(bad)
        for a, b in rim:
            cross = (p[b][0] - p[a][0]) * (p[i][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[i][0] - p[a][0])
            if abs(cross) > 1e-12 * span * span:
                tri.add((a, b, i) if cross > 0 else (b, a, i))
    return np.array(sorted(t for t in tri if max(t) < n)).reshape(-1, 3)


def stable_ids(cells: DataFrame) -> DataFrame:
    """Ids 1..n by box centre, area and former id, so equal tessellations number their cells alike."""
    from .joins import global_rank

    centre = [F.round((F.col(f"{c}min") + F.col(f"{c}max")) / 2, 9).alias(f"__{c}") for c in "xy"]
    ranked = global_rank(cells.select("*", *centre, F.abs(shoelace("rings")).alias("__area")), "__x", "__y", "__area", "cell_id", name="__rank")
    return ranked.withColumn("cell_id", (F.col("__rank") + 1).cast("long")).select(cells.columns)


def cached_grid(spark: SparkSession, box, target: int, kind: str = "square", boundary: list | None = None, crs=None) -> DataFrame:
    """A grid kept by session, extent, boundary, coordinate system and parameters; with a boundary it is cut to it."""
    from .polygons import grid_polygons

    edge = None if boundary is None else [np.asarray(r, float).tolist() for r in boundary]
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, box, target, kind, edge, crs)).encode()).hexdigest()
    if key not in _grids:
        if boundary is not None:
            made = grid_polygons(spark, boundary, target, kind)
        else:
            nx, ny = grid_size(box[1] - box[0], box[3] - box[2], target, kind)
            made = hex_grid(spark, box, (box[1] - box[0]) / nx) if kind == "hex" else square_grid(spark, box, nx, ny)
        _grids[key] = made.persist()
    return _grids[key]


def clear_grid_cache() -> int:
    n = len(_grids)
    for df in _grids.values():
        df.unpersist()
    _grids.clear()
    return n


def kmeans_seeds(points: DataFrame, k: int, seed: int = 456, starts: int = 10, iterations: int = 50) -> DataFrame:
    """``seed_id, x, y``: centres of the best of several k-means runs.

    Points of one place are one row with their number as its weight, dealt over all cores by their place: the runs do not
    depend on the files' partitions, and a small file is not one task.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from .dealing import dealt

    places = dealt(points.select("x", "y"), "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # four tasks a core shorten the grouping; a pass of k-means is short work, for which one a core is enough
    places = places.coalesce(points.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("x", "y")
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(places).select("features", "weight").persist()
    v.count()
    with ThreadPoolExecutor(4) as pool:  # a pass is a short job: the driver's share of some starts passes while others work
        fits = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=iterations, weightCol="weight").fit(v), range(starts)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    v.unpersist()
    rows = sorted(tuple(map(float, c)) for c in best.clusterCenters())
    return points.sparkSession.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(rows)], "seed_id long, x double, y double")


def elbow(wss: list[float], min_k: int = 1) -> tuple[int, list[int]]:
    """(knee, candidates): the k farthest from the chord of the normalised curve; flat or short curves give the middle."""
    n = len(wss)
    if n < 3 or max(wss) - min(wss) <= 1e-12 * max(abs(w) for w in wss):
        knee = min_k + (n - 1) // 2
    else:
        k = np.linspace(0, 1, n)
        w = (np.array(wss) - min(wss)) / (max(wss) - min(wss))
        gap = np.abs((w[-1] - w[0]) * k - (k[-1] - k[0]) * w + k[-1] * w[0] - w[-1] * k[0]) / math.hypot(w[-1] - w[0], 1)
        knee = min_k + int(np.argmax(gap))
    return knee, [c for c in (knee - 1, knee, knee + 1) if min_k <= c <= min_k + n - 1]


def random_seeds(spark: SparkSession, boundary: np.ndarray, k: int, seed: int = 456) -> DataFrame:
    """``seed_id, x, y``: k points uniform in a polygon ring, by rejection from its box; fewer if ten rounds don't fill it."""
    lo, hi = boundary.min(0), boundary.max(0)
    rng, found = np.random.default_rng(seed), np.zeros((0, 2))
    for _ in range(10):
        p = lo + rng.random((max(64, 2 * k), 2)) * (hi - lo)
        a, b = boundary, np.roll(boundary, -1, 0)
        cross = ((a[:, 1] > p[:, 1:]) != (b[:, 1] > p[:, 1:])) & (p[:, :1] < (b[:, 0] - a[:, 0]) * (p[:, 1:] - a[:, 1]) / np.where(b[:, 1] == a[:, 1], np.inf, b[:, 1] - a[:, 1]) + a[:, 0])
        found = np.vstack([found, p[cross.sum(1) % 2 == 1]])
        if len(found) >= k:
            break
    return spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(found[:k])], "seed_id long, x double, y double")


def clip_box(points: DataFrame, expand: float = 0.0) -> tuple[float, float, float, float]:
    """The extent of points; ``expand`` below 1 is a share of the longer side, else a distance.  Flat extents are padded."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    longest = max(x1 - x0, y1 - y0)
    pad = expand * longest if 0 < expand < 1 else expand
    if x1 == x0 or y1 == y0:
        pad = pad or (0.05 * longest or 1.0)
    return x0 - pad, x1 + pad, y0 - pad, y1 + pad


def clip_target(points: DataFrame, boundary: list | None = None, expand: float = 0.0) -> list[np.ndarray]:
    """The area that a tessellation of points is clipped to, as valid rings.

    A boundary, else the points' box; an extent without width or height becomes a band around the points instead.
    ``expand`` between 0 and 1 is a share of the longer side of the box, else a distance; a negative one shrinks.
    """
    from .overlay import buffer, make_valid

    def distance(box, share):
        longest = max(box[1] - box[0], box[3] - box[2])
        return share * longest if 0 < share < 1 else share

    if boundary is not None:
        flat = np.vstack(make_valid(boundary))
        (x0, y0), (x1, y1) = flat.min(0), flat.max(0)
        return buffer(boundary, distance((x0, x1, y0, y1), expand))
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        raise ValueError("a layer without points has no extent")
    if math.isclose(x0, x1, rel_tol=1.5e-8) or math.isclose(y0, y1, rel_tol=1.5e-8):
        wide = distance((x0, x1, y0, y1), expand or 0.05)
        return _band(points, wide if wide > 0 else 1.0)
    return buffer([_box_ring(x0, y0, x1, y1)], distance((x0, x1, y0, y1), expand))


def _band(points: DataFrame, distance: float) -> list[np.ndarray]:
    """The union of circles around points of a layer, united tile by tile in tasks."""
    from .overlay import RINGS, arrays, dissolve

    t = [k * math.pi / 60 for k in range(120)]
    corner = [F.struct((F.col("x") + distance * math.cos(a)).alias("x"), (F.col("y") + distance * math.sin(a)).alias("y")) for a in t]
    round_ = points.select("x", "y").distinct().select(F.array(F.array(*corner)).cast(RINGS).alias("rings"), *[(F.col(c) + s * distance).alias(f"{c}{n}") for n, s in (("min", -1), ("max", 1)) for c in "xy"])
    return [r for row in dissolve(round_).select("rings").collect() for r in arrays(row["rings"])]


def build_tessellation(points: DataFrame, method: str = "voronoi", target: int = 100, boundary: np.ndarray | list | None = None, expand: float = 0.0, clip: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells, index) of a point layer by method: voronoi, triangles, square or hex; ``index`` is ``row_id, cell_id``.

    ``boundary`` is a ring or a list of rings of any shape; cells are cut to it, or to the points' clip target, unless
    ``clip`` is false.
    """
    from ..sources.layer import dedup_points
    from .assign import point_cell_index
    from .overlay import clip_cells
    from .polygons import grid_polygons
    from .triangulate import delaunay_triangles

    spark = points.sparkSession
    if boundary is not None and not isinstance(boundary, list):
        boundary = [np.asarray(boundary, float)]
    if method not in ("voronoi", "triangles", "square", "hex"):
        raise ValueError(f"unknown method: {method}")
    area = clip_target(points, boundary, expand)
    if method == "voronoi":
        return create_voronoi(points, area, clip=clip)
    if method == "triangles":
        places = dedup_points(points)
        if places.limit(3).count() < 3:
            raise ValueError("a triangulation needs three points")
        cells = delaunay_triangles(places).select(F.xxhash64("a", "b", "c").alias("cell_id"), "rings", "xmin", "ymin", "xmax", "ymax")
        cells = stable_ids(clip_cells(cells, area) if clip and boundary is not None else cells)
    else:
        cells = grid_polygons(spark, area, target=target, kind=method, clip=clip)
    cells = cells.persist()
    return cells, point_cell_index(points, cells)


def optimal_levels(points: DataFrame, max_levels: int = 12, top_n: int = 3, sample_n: int = 1500, seed: int = 123, response: str | None = None, predictors=(), criterion: str | None = None) -> tuple[list[int], list[dict]]:
    """(best numbers of cells, diagnostics) by ``criterion``: ``geometric``, the elbow of k-means within-sums and its neighbours;
    ``morans_i``, the numbers near the elbow whose cell means leave the least Moran's I in size; ``combined``, both by their mean
    ranks, ties averaged.  The default is combined with a response, geometric without; the others fall back to it without a
    response or where Moran's I can't be computed, with a warning."""
    import logging

    log = logging.getLogger("terrastat")
    criterion = criterion or ("combined" if response is not None else "geometric")
    if criterion not in ("geometric", "morans_i", "combined"):
        raise ValueError(f"unknown criterion: {criterion}")
    if criterion != "geometric" and response is None:
        log.warning("%s needs a response: geometric is used", criterion)
        criterion = "geometric"
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from .autocorr import knn_weights, morans_i
    from .metrics import linear, ols

    part = points.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(sample_n).persist()
    n = part.select(F.round("x", 10), F.round("y", 10)).distinct().count()
    k_max = min(max_levels, n - 1)
    if n < 3 or k_max < 2:
        return [1], []
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(part).persist()
    fits = {k: KMeans(k=k, seed=seed, maxIter=50).fit(v) for k in range(2, k_max + 1)}
    one = part.agg((F.var_pop("x") + F.var_pop("y")) * F.count(F.lit(1))).first()[0]
    wss = [one] + [fits[k].summary.trainingCost for k in range(2, k_max + 1)]
    knee, near = elbow(wss)
    out = [{"k": k, "wss": w} for k, w in enumerate(wss, 1)]
    if criterion == "geometric":
        return near[:top_n], out
    tried = [k for k in range(max(2, knee - max(4, top_n)), min(k_max, knee + max(4, top_n)) + 1)]
    for k in tried:
        cells = fits[k].transform(v).groupBy("prediction").agg(*[F.avg(c).alias(c) for c in ("x", "y", response, *predictors)]).withColumnRenamed("prediction", "row_id").persist()
        beta = ols(cells, response, list(predictors)) if k >= 4 else None
        i = None
        if beta is not None:
            r = morans_i(cells.select("row_id", (F.col(response) - linear(beta, list(predictors))).alias("e")), knn_weights(cells, 8)).first()
            i = abs(r["I"]) if r["I"] is not None else None
        out[k - 1] |= {"moran": i}
    if all(out[k - 1]["moran"] is None for k in tried):
        log.warning("Moran's I could not be computed: geometric is used")
        return near[:top_n], out
    if criterion == "morans_i":
        return sorted((k for k in tried if out[k - 1]["moran"] is not None), key=lambda k: (out[k - 1]["moran"], k))[:top_n], out
    # distance to the chord of the curve over the numbers tried; a missing Moran ranks last
    x = (np.array(tried) - tried[0]) / max(1, tried[-1] - tried[0])
    w = np.array([wss[k - 1] for k in tried])
    w = (w - w.min()) / max(np.ptp(w), 2.220446049250313e-16)
    chord = math.hypot(x[-1] - x[0], w[-1] - w[0])
    gaps = np.abs((w[-1] - w[0]) * x - (x[-1] - x[0]) * w + x[-1] * w[0] - w[-1] * x[0]) / chord if chord > 2.220446049250313e-16 else np.zeros(len(x))
    known = [out[k - 1]["moran"] for k in tried if out[k - 1]["moran"] is not None]
    for k, gap in zip(tried, gaps.tolist(), strict=True):
        out[k - 1]["gap"] = gap

    def ranks(values):
        order = sorted(values)
        return [order.index(x) + (order.count(x) - 1) / 2 for x in values]

    a = ranks([-out[k - 1]["gap"] for k in tried])
    b = ranks([max([*known, 1]) + 1 if out[k - 1]["moran"] is None else out[k - 1]["moran"] for k in tried])
    return [k for _, k in sorted(zip([(p + q) / 2 for p, q in zip(a, b, strict=True)], tried, strict=True))][:top_n], out
