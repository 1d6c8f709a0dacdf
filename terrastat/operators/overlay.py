"""Polygon overlay: union, intersection, difference, repair and buffers of any polygons, as rings.

A geometry is a list of rings; what its rings wind around an odd number of times (or, where said, a positive number of
times) is its inside.  The kernel nodes all edges, counts for each noded edge how often either side is wound
around, keeps the edges whose sides differ and traces them into rings: outer rings counter-clockwise, holes clockwise, parts
that touch in a point as rings of their own.  It runs in tasks on one feature or one pair of features that met in a bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import edges_of, shoelace
from .dealing import dealt
from .tessellate import CELL

BLOCK = 256  # edges that meet all others at once
PAIRS = 1 << 18  # of edges that are compared at once
ROUNDS = 6  # of noding
GRID = 2.0**-40  # of the extent: nodes are rounded to this grid
RULES = {
    "union": lambda p, q: p | q,
    "intersection": lambda p, q: p & q,
    "difference": lambda p, q: p & ~q,
    "symmetric": lambda p, q: p ^ q,
}
RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings) -> np.ndarray:
    """(n, 2, 2): the edges of rings, without those of no length."""
    parts = [np.stack([r, np.roll(r, -1, 0)], 1) for r in (np.asarray(r, float).reshape(-1, 2) for r in rings) if len(r) > 1]
    out = np.concatenate(parts) if parts else np.zeros((0, 2, 2))
    return out[(out[:, 0] != out[:, 1]).any(1)]


def _cuts(segments: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(edge, point) of all points where an edge must be split, strictly between its ends."""
    low, high = segments.min(1) - slack, segments.max(1) + slack
    order = np.argsort(low[:, 0], kind="stable")
    out_e, out_p = [], []
    for at in range(0, len(order), BLOCK):
        mine = order[at : at + BLOCK]
        # later edges in order of their left ends, as far as they begin left of this block's right end
        last = np.searchsorted(low[order, 0], high[mine, 0].max(), "right")
        rest = order[at:last]
        meet = (low[mine][:, None, :] <= high[rest][None]).all(2) & (low[rest][None] <= high[mine][:, None, :]).all(2)
        first, second = np.nonzero(meet)
        keep = first < second  # ``rest`` begins with ``mine``
        first, second = mine[first[keep]], rest[second[keep]]
        for b in range(0, len(first), PAIRS):
            e, p = _cuts_of(segments, first[b : b + PAIRS], second[b : b + PAIRS], slack)
            out_e.append(e)
            out_p.append(p)
    if not out_e:
        return np.zeros(0, int), np.zeros((0, 2))
    return np.concatenate(out_e), np.concatenate(out_p)


def _cuts_of(segments: np.ndarray, i: np.ndarray, j: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """``_cuts`` of the pairs of edges ``i, j``."""
    out_e, out_p = [], []
    a, d = segments[i, 0], segments[i, 1] - segments[i, 0]
    c, e = segments[j, 0], segments[j, 1] - segments[j, 0]
    cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    gap = c - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[:, 0] * e[:, 1] - gap[:, 1] * e[:, 0]) / cross
        u = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / cross
    size_d, size_e = np.hypot(*d.T), np.hypot(*e.T)
    steep = np.abs(cross) > 1e-14 * size_d * size_e
    hit = steep & (t > -slack / size_d) & (t < 1 + slack / size_d) & (u > -slack / size_e) & (u < 1 + slack / size_e)
    point = a[hit] + t[hit, None] * d[hit]
    for edge, place in ((i[hit], t[hit]), (j[hit], u[hit])):
        inner = (place > 0) & (place < 1)
        out_e.append(edge[inner])
        out_p.append(point[inner])
    # ends of one edge on the other, which collinear edges share
    for edge, other in ((i, j), (j, i)):
        for end in (0, 1):
            p, q, v = segments[other, end], segments[edge, 0], segments[edge, 1] - segments[edge, 0]
            place = ((p - q) * v).sum(1) / (v * v).sum(1)
            near = (place > 0) & (place < 1) & (np.abs((p - q)[:, 0] * v[:, 1] - (p - q)[:, 1] * v[:, 0]) <= slack * np.hypot(*v.T))
            out_e.append(edge[near])
            out_p.append(p[near])
    return np.concatenate(out_e), np.concatenate(out_p)


def _merged(segments: np.ndarray, owner: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One edge a place and owner, from its lesser end: how often (``net``) it runs that way, less the other.  What runs both
    ways as often is nothing that could be wound around."""
    turned = (segments[:, 0, 0] > segments[:, 1, 0]) | ((segments[:, 0, 0] == segments[:, 1, 0]) & (segments[:, 0, 1] > segments[:, 1, 1]))
    segments = np.where(turned[:, None, None], segments[:, ::-1], segments)
    net = np.where(turned, -net, net)
    order = np.lexsort([owner, *segments.reshape(-1, 4).T[::-1]])
    segments, owner, net = segments[order], owner[order], net[order]
    new = np.ones(len(order), bool)
    new[1:] = (segments[1:] != segments[:-1]).any((1, 2)) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    net = np.add.reduceat(net, start) if len(start) else net
    some = (net != 0) & (segments[start, 0] != segments[start, 1]).any(1)
    return segments[start[some]], owner[start[some]], net[some]


def _noded(segments: np.ndarray, owner: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_merged`` edges that meet in their ends only; ends lie on the grid of ``unit``.

    Edges of one place are merged in each round, and an edge is cut once at each point of the grid: edges that nearly
    coincide would else cut each other into ever more copies."""
    snap = lambda p: np.round(p / unit) * unit + 0.0  # noqa: E731  (no negative zeros)
    segments, owner, net = _merged(snap(segments), owner, np.ones(len(segments), int))
    for _ in range(ROUNDS):  # rounding may make edges touch again
        edge, point = _cuts(segments, unit)
        point = snap(point)
        real = (point != segments[edge, 0]).any(1) & (point != segments[edge, 1]).any(1)
        edge, point = edge[real], point[real]
        if not len(edge):
            break
        n, v = len(segments), segments[:, 1] - segments[:, 0]
        place = ((point - segments[edge, 0]) * v[edge]).sum(1) / (v * v).sum(1)[edge]
        all_e = np.concatenate([np.arange(n), edge, np.arange(n)])
        all_t = np.concatenate([np.full(n, -1.0), np.clip(place, 0.0, 1.0), np.full(n, 2.0)])
        all_p = np.concatenate([segments[:, 0], point, segments[:, 1]])
        order = np.lexsort([all_p[:, 1], all_p[:, 0], all_t, all_e])
        all_e, all_p = all_e[order], all_p[order]
        again = np.zeros(len(order), bool)
        again[1:] = (all_e[1:] == all_e[:-1]) & (all_p[1:] == all_p[:-1]).all(1)
        all_e, all_p = all_e[~again], all_p[~again]
        same = all_e[1:] == all_e[:-1]
        cut = all_e[:-1][same]
        segments, owner, net = _merged(np.stack([all_p[:-1][same], all_p[1:][same]], 1), owner[cut], net[cut])
    return segments, owner, net


def _windings(segments: np.ndarray, counts: np.ndarray, upright: np.ndarray) -> np.ndarray:
    """How often each owner winds around the far side (right of upright edges, above others) of each edge."""
    out = np.zeros(counts.shape, int)
    mid = segments.mean(1)
    step = max(1, min(BLOCK, PAIRS // len(segments)))
    for tall in (True, False):
        rows = np.flatnonzero(upright == tall)
        x, y = (0, 1) if tall else (1, 0)
        lo, hi = segments[:, 0, y], segments[:, 1, y]
        for b in range(0, len(rows), step):
            r = rows[b : b + step]
            my, mx = mid[r, y][:, None], mid[r, x][:, None]
            across = (lo > my) != (hi > my)
            with np.errstate(divide="ignore", invalid="ignore"):
                where = segments[:, 0, x] + (my - lo) / (hi - lo) * (segments[:, 1, x] - segments[:, 0, x])
            across &= where > mx
            across[np.arange(len(r)), r] = False
            # edges that go up on the right wind once around, those that go down the other way; turned for the other axis
            sign = np.where(hi > lo, 1, -1) * (1 if tall else -1)
            out[r] = (across * sign) @ counts
    return out


def arrange(geometries: list, inside: Callable) -> list[np.ndarray]:
    """Rings of the region where ``inside(w)`` holds; ``w`` is (n, len(geometries)), how often each geometry winds around a
    place."""
    parts = [edges(g) for g in geometries]
    segments = np.concatenate(parts) if parts else np.zeros((0, 2, 2))
    if not len(segments) or not np.isfinite(segments).all():
        return []
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    low = segments.reshape(-1, 2).min(0)
    unit = 2.0 ** np.ceil(np.log2((segments - low).max() * GRID))
    origin = np.floor(low / unit) * unit  # of the grid, so that places that geometries share are rounded to the same point
    segments, owner, net = _noded(segments - origin, owner, unit)
    if not len(segments):
        return []
    new = np.ones(len(segments), bool)
    new[1:] = (segments[1:] != segments[:-1]).any((1, 2))
    counts = np.zeros((np.count_nonzero(new), len(parts)), int)
    counts[np.cumsum(new) - 1, owner] = net
    segments = segments[new]
    span = np.abs(segments[:, 1] - segments[:, 0])
    upright = span[:, 1] > span[:, 0]
    far = _windings(segments, counts, upright)
    # an edge's left side is wound around once more than its right one; the far side is right of edges that go up, left of
    # others (edges run from their lesser end, so those that are no taller than wide run right)
    up = segments[:, 1, 1] > segments[:, 0, 1]
    far_is_left = np.where(upright, ~up, True)[:, None]
    near = far + np.where(far_is_left, -1, 1) * counts
    left, right = inside(np.where(far_is_left, far, near)), inside(np.where(far_is_left, near, far))
    edge = left != right
    rim = segments[edge]
    rim = np.where(left[edge][:, None, None], rim, rim[:, ::-1])
    return [r + origin for r in _traced(rim)]


def _traced(rim: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges with their inside to the left."""
    if not len(rim):
        return []
    nodes, ends = np.unique(rim.reshape(-1, 2), axis=0, return_inverse=True)
    ends = ends.reshape(-1, 2)
    angle = np.arctan2(*(rim[:, 1] - rim[:, 0]).T[::-1])
    leaving: dict[int, list] = {}
    for e, (a, _) in enumerate(ends.tolist()):
        leaving.setdefault(a, []).append(e)
    free, out = np.ones(len(rim), bool), []
    for first in range(len(rim)):
        if not free[first]:
            continue
        ring, e = [], first
        while free[e]:
            free[e] = False
            ring.append(ends[e, 0])
            choices = [c for c in leaving[ends[e, 1]] if free[c] or c == first]
            if not choices:
                break
            back = angle[e] + np.pi
            # the first edge clockwise from the way back
            e = choices[0] if len(choices) == 1 else min(choices, key=lambda c: ((back - angle[c] - 1e-12) % (2 * np.pi)))
        for part in _apart(ring):
            points = _straightened(nodes[part])
            if len(points) > 2:
                out.append(points)
    return out


def _apart(ring: list) -> Iterator[list]:
    """A walk that comes back to a node is cut there into rings."""
    walk, at = [], {}
    for n in ring:
        if n in at:
            yield walk[at[n] :]
            for gone in walk[at[n] + 1 :]:
                del at[gone]
            del walk[at[n] + 1 :]
        else:
            at[n] = len(walk)
            walk.append(n)
    yield walk


def _straightened(ring: np.ndarray) -> np.ndarray:
    """Without vertices on the way between their neighbours."""
    a, b = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    cross = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return ring[np.abs(cross) > 1e-11 * np.hypot(*a.T) * np.hypot(*b.T)]


def _odd(w):
    return w % 2 == 1


def overlay(p: list, q: list, how: str = "intersection") -> list[np.ndarray]:
    """``union``, ``intersection``, ``difference`` or ``symmetric`` difference of two geometries (insides: odd)."""
    rule = RULES[how]
    return arrange([p, q], lambda w: rule(_odd(w[:, 0]), _odd(w[:, 1])))


def common(p: list, q: list) -> list[np.ndarray]:
    """``overlay(p, q)`` where ``q`` is valid and the larger: rings of ``p`` far from its rim are all in or all out."""
    if not p or not q:
        return []
    flat = np.concatenate(p)
    lo, hi = flat.min(0), flat.max(0)
    for ring in q:
        after = np.roll(ring, -1, 0)
        if ((np.minimum(ring, after) <= hi) & (np.maximum(ring, after) >= lo)).all(1).any():
            return overlay(p, q)
    return make_valid(p) if holds(flat.mean(0)[None], q)[0] else []


def convex(rings: list) -> list | None:
    """The corners of a geometry of one convex ring, counter-clockwise; None for any other, also for one with a corner that
    hardly turns."""
    if len(rings) != 1 or len(rings[0]) < 3:
        return None
    ring = np.asarray(rings[0], float).tolist()
    (ax, ay), (bx, by) = ring[-2], ring[-1]
    dx, dy, left, turns = bx - ax, by - ay, None, 0.0
    for x, y in ring:
        ex, ey = x - bx, y - by
        cross = dx * ey - dy * ex
        if not cross * cross > 1e-22 * (dx * dx + dy * dy) * (ex * ex + ey * ey) or cross * cross == math.inf:  # nan too
            return None
        if left is None:
            left = cross > 0
        elif left != (cross > 0):
            return None
        if len(ring) > 4:  # fewer corners turn around once
            turns += abs(math.atan2(cross, dx * ex + dy * ey))
        bx, by, dx, dy = x, y, ex, ey
    if turns > 3 * math.pi:
        return None
    return ring if left else ring[::-1]


def half_plane(ring: list, a: float, b: float, c: float) -> list:
    """The corners of the part of a ring where a x + b y <= c (exact for convex rings)."""
    if not ring:
        return ring
    out = []
    px, py = ring[-1]
    s = a * px + b * py - c
    for x, y in ring:
        t = a * x + b * y - c
        if s * t < 0:
            k = s / (s - t)
            out.append([px + (x - px) * k, py + (y - py) * k])
        if t <= 0:
            out.append([x, y])
        px, py, s = x, y, t
    return out


def common_convex(p: list, q: list) -> list:
    """The corners that two convex, counter-clockwise rings have in common."""
    ax, ay = q[-1]
    for bx, by in q:
        dx, dy = bx - ax, by - ay
        p = half_plane(p, dy, -dx, dy * ax - dx * ay)
        ax, ay = bx, by
    return p


def make_valid(rings: list) -> list[np.ndarray]:
    """The same inside with rings that neither cross nor repeat themselves; outer rings counter-clockwise."""
    ring = convex(rings)
    if ring is not None:
        return [np.array(ring)]
    return arrange([rings], lambda w: _odd(w[:, 0]))


def union_all(geometries: list) -> list[np.ndarray]:
    return arrange(geometries, lambda w: _odd(w).any(1))


def buffer(rings: list, distance: float, segments: int = 30) -> list[np.ndarray]:
    """A geometry grown by a distance, or shrunk by a negative one.  Corners are arcs of ``segments`` steps a quadrant.

    Each ring's offset curve turns around the corners on its outer side in arcs and passes through the other ones; what
    the curves wind around a positive number of times is the buffer.
    """
    rings = make_valid(rings)
    if distance == 0 or not rings:
        return rings
    ring = convex(rings)
    if ring is not None:
        return _buffer_convex(ring, distance, segments)
    curves = []
    for ring in rings:
        d = np.roll(ring, -1, 0) - ring
        d = d / np.hypot(*d.T)[:, None]
        out = np.column_stack([d[:, 1], -d[:, 0]]) * distance  # to the right of each edge, or to its left
        before = np.roll(out, 1, 0)
        turn = np.roll(d, 1, 0)
        cross = turn[:, 0] * d[:, 1] - turn[:, 1] * d[:, 0]
        bend = np.arctan2(cross, (turn * d).sum(1))
        curve = []
        for k, corner in enumerate(ring):
            if cross[k] * distance > 0 or (cross[k] == 0 and (turn[k] * d[k]).sum() < 0):
                steps = max(1, int(np.ceil(abs(bend[k]) / (np.pi / 2) * segments - 1e-9)))
                t = np.linspace(0, bend[k], steps + 1)
                c, s = np.cos(t), np.sin(t)
                curve.append(corner + np.column_stack([before[k, 0] * c - before[k, 1] * s, before[k, 0] * s + before[k, 1] * c]))
            else:
                curve.append(np.array([corner + before[k], corner, corner + out[k]]))
        curves.append(np.vstack(curve))
    return arrange([curves], lambda w: w[:, 0] > 0)


def _buffer_convex(ring: list, distance: float, segments: int) -> list[np.ndarray]:
    """Of one convex ring: its offset curve meets itself nowhere; inwards it is what the moved edges leave."""
    p = np.array(ring)
    d = np.roll(p, -1, 0) - p
    d /= np.hypot(d[:, 0], d[:, 1])[:, None]
    if distance < 0:
        low = p[:, 0] * d[:, 1] - p[:, 1] * d[:, 0] + distance
        for (dx, dy), c in zip(d.tolist(), low.tolist(), strict=True):
            ring = half_plane(ring, dy, -dx, c)
        left = _straightened(np.array(ring)[(np.array(ring) != np.roll(ring, 1, 0)).any(1)]) if len(ring) > 2 else []
        return [left] if len(left) > 2 else []
    before = np.roll(d, 1, 0)
    bend = np.arctan2(before[:, 0] * d[:, 1] - before[:, 1] * d[:, 0], (before * d).sum(1))
    steps = np.maximum(1, np.ceil(bend / (np.pi / 2) * segments - 1e-9).astype(int))
    corner = np.repeat(np.arange(len(p)), steps + 1)
    at = np.arange(len(corner)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    t = at * (bend / steps)[corner]
    c, s = np.cos(t), np.sin(t)
    ox, oy = before[corner, 1] * distance, -before[corner, 0] * distance
    return [p[corner] + np.column_stack([ox * c - oy * s, ox * s + oy * c])]


def signed_area(rings: list) -> float:
    """Area of valid rings."""
    return float(sum((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2 for x, y in (r.T for r in rings)))


def holds(points: np.ndarray, rings: list) -> np.ndarray:
    """Whether points lie inside a geometry (odd); for points on edges undefined."""
    e = edges(rings)
    odd = np.zeros(len(points), bool)
    for b in range(0, len(points), BLOCK):
        x, y = points[b : b + BLOCK, :1], points[b : b + BLOCK, 1:]
        (ax, ay), (bx, by) = e[:, 0].T, e[:, 1].T
        with np.errstate(divide="ignore", invalid="ignore"):
            odd[b : b + BLOCK] = (((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).sum(1) % 2 == 1
    return odd


# layers


def packed(rings, name: str = "") -> list[Column]:
    """Rings as two columns, ``<name>xy`` and ``<name>sizes``: nested arrays of unequal lengths do not reach pandas."""
    numbers = F.flatten(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))))
    return [numbers.alias(f"{name}xy"), F.transform(rings, F.size).alias(f"{name}sizes")]


def unpacked(xy, sizes) -> list[np.ndarray]:
    """The rings of one row of ``packed`` columns; none for null."""
    if xy is None or not len(sizes):
        return []
    return np.split(np.asarray(xy, float).reshape(-1, 2), np.cumsum(np.asarray(sizes, int))[:-1])


def arrays(rings) -> list[np.ndarray]:
    """Rings of a collected row."""
    return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in (rings if rings is not None else [])]


def structs(rings: list) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def _mapped(features: DataFrame, make: Callable, rings_col: str) -> DataFrame:
    """``features`` with its rings made anew and box columns to match; rows left without area have no rings and null boxes."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    kept = [c for c in features.columns if c not in (rings_col, *box)]
    schema = ", ".join([f"`{c}` {features.schema[c].dataType.simpleString()}" for c in kept] + [f"`{rings_col}` {RINGS}", *[f"{c} double" for c in box]])

    def run(frames):
        for f in frames:
            made = [make(unpacked(xy, n)) for xy, n in zip(f["__xy"], f["__sizes"], strict=True)]
            out = f[kept].copy()
            out[rings_col] = [structs(m) for m in made]
            boxes = [[*np.vstack(m).min(0), *np.vstack(m).max(0)] if m else [None] * 4 for m in made]
            for k, c in enumerate(box):
                out[c] = pd.array([b[k] for b in boxes], dtype="Float64")
            yield out

    return dealt(features.select(*kept, *packed(F.col(rings_col), "__"))).mapInPandas(run, schema)


def repaired(features: DataFrame, rings_col: str = "rings") -> DataFrame:
    """Features with valid rings (``make_valid``), box columns to match.  Null rings and rings without area become empty."""
    return _mapped(features, make_valid, rings_col)


def buffered(features: DataFrame, distance: float, segments: int = 30, rings_col: str = "rings") -> DataFrame:
    """Features grown, or shrunk by a negative distance; what vanishes has no rings."""
    return _mapped(features, lambda rings: buffer(rings, distance, segments), rings_col)


def clip_cells(cells: DataFrame, boundary: list) -> DataFrame:
    """The parts of cells inside a boundary, which may be concave, in parts or with holes; cells may be any polygons.  A
    part's rings are its own, so nothing outside the boundary belongs to a cell; cells without area inside drop out."""
    boundary = make_valid(boundary)

    def clipped(cell):
        return common(cell, boundary)

    def run(frames):
        for f in frames:
            out = []
            for i, xy, n in zip(f["cell_id"], f["xy"], f["sizes"], strict=True):
                cell = [r for r in unpacked(xy, n) if len(r) > 2]
                parts = clipped(cell) if cell else []
                if parts:
                    flat = np.vstack(parts)
                    out.append((i, structs(parts), *flat.min(0), *flat.max(0)))
            yield pd.DataFrame(out, columns=["cell_id", "rings", "xmin", "ymin", "xmax", "ymax"])

    return dealt(cells.select("cell_id", *packed(F.col("rings")))).mapInPandas(run, CELL)


def _uncovered(shapes: list) -> list:
    """Shapes without those whose box lies in a larger convex one: their union is the same."""
    shapes = [s for s in shapes if s]
    box = np.array([[*np.vstack(s).min(0), *np.vstack(s).max(0)] for s in shapes]).reshape(-1, 4)
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    gone, out = np.zeros(len(shapes), bool), []
    for k in np.argsort(-size, kind="stable"):
        if gone[k]:
            continue
        out.append(shapes[k])
        ring = convex(shapes[k])
        if ring is None:
            continue
        inside = ~gone
        inside[k] = False
        ax, ay = ring[-1]
        for bx, by in ring:
            dx, dy = bx - ax, by - ay
            least = np.minimum(dx * (box[:, 1] - ay), dx * (box[:, 3] - ay)) - np.maximum(dy * (box[:, 0] - ax), dy * (box[:, 2] - ax))
            inside &= least >= 0
            ax, ay = bx, by
        gone |= inside
    return out


def dissolve(features: DataFrame, by: str | None = None, tile: float | None = None) -> DataFrame:
    """``by, rings`` and boxes: the union of the features (``rings`` and boxes) of each group, or of all.

    Features are dealt over square tiles that they touch, cut to them and united there, so that a group's unions run
    in many tasks; tiles are joined by eights along both axes, and then dissolve the seams.  A tile that one feature covers is
    whole, whatever else touches it.  ``tile`` is by default the side of about 16 features' share of a group's extent, between half
    of and four times the features' mean side: the deeper features lie on each other, the more tiles are whole.
    A group's result is one row, as large as its outline.
    """
    key = by or "__all"
    rows = features if by else features.withColumn(key, F.lit(1))
    rows = rows.where("xmin is not null").select(key, "rings", "xmin", "ymin", "xmax", "ymax")
    if tile is None:
        side, n, groups, width, height = rows.agg(
            F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))), F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit(""))),
            F.max("xmax") - F.min("xmin"), F.max("ymax") - F.min("ymin"),
        ).first()
        side = side or 0.25
        tile = min(4 * side, max(side / 2, math.sqrt(16 * max(groups, 1) * (width or 1.0) * (height or 1.0) / max(n, 1))))
        step = 2.0 ** (math.floor(math.log2(tile)) - 7)
        tile = math.ceil(tile / step) * step  # of eight bits, so that seams lie on the grid of any part
    for axis in "xy":
        rows = rows.withColumn(f"__t{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}min") / tile), F.floor(F.col(f"{axis}max") / tile))))
    kind = features.schema[by].dataType.simpleString() if by else "int"
    at = [key, "__tx", "__ty"]
    schema = f"`{key}` {kind}, __tx long, __ty long, rings {RINGS}, xmin double, ymin double, xmax double, ymax double"

    def united(frame, cut: bool):
        tx, ty = (int(frame[c].iloc[0]) for c in ("__tx", "__ty"))
        shapes = [unpacked(xy, n) for xy, n in zip(frame["xy"], frame["sizes"], strict=True)]
        if cut:
            x0, y0, x1, y1 = tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile
            square = [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
            # what is cut off runs along the square's rim, which no inside depends on
            shapes = _uncovered([[np.array(r) for r in (common_convex(r.tolist(), square) for r in s) if len(r) > 2] for s in shapes])
        while len(shapes) > 1:  # few first: edges inside go before they meet all others
            shapes = [union_all(shapes[k : k + 8]) for k in range(0, len(shapes), 8)]
        rings = make_valid(shapes[0]) if shapes else []
        row = {key: frame[key].iloc[0], "__tx": tx, "__ty": ty, "rings": structs(rings)}
        flat = np.vstack(rings) if rings else None
        row |= dict(zip(("xmin", "ymin", "xmax", "ymax"), [*flat.min(0), *flat.max(0)] if rings else [None] * 4))
        return pd.DataFrame([row]) if rings else pd.DataFrame(columns=list(row))

    edge = [F.col("__tx") * tile, F.col("__ty") * tile, (F.col("__tx") + 1) * tile, (F.col("__ty") + 1) * tile]
    marked = rows.withColumn("__whole", _covers(F.col("rings"), *edge))
    whole = dealt(marked.where("__whole").select(*at).distinct(), *at)
    open_ = dealt(marked.where("not __whole").select(*at, *packed(F.col("rings"))), *at).alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at]
    tiles = open_.join(whole.alias("b"), same, "left_anti").groupBy(*at).applyInPandas(lambda f: united(f, True), schema)
    corner = [F.struct(edge[i].alias("x"), edge[j].alias("y")) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    out = tiles.select(*at, *packed(F.col("rings"))).unionByName(whole.select(*at, *packed(F.array(F.array(*corner)))))
    for eights in (True, False):
        up = [(F.floor(F.col(c) / 8) if eights else F.lit(0)).cast("long").alias(c) for c in ("__tx", "__ty")]
        out = dealt(out.select(key, *up, "xy", "sizes"), *at).groupBy(*at).applyInPandas(lambda f: united(f, False), schema)
        if eights:
            out = out.select(*at, *packed(F.col("rings")))
    out = out.drop("__tx", "__ty")
    return out if by else out.drop(key)


def _covers(rings: Column, x0, y0, x1, y1) -> Column:
    """Whether a geometry of one ring of at most four corners holds a box: the box lies on one side of all its edges, around
    which so few can wind only once."""
    across = lambda e: (e["bx"] - e["ax"], e["by"] - e["ay"])

    def least(e, sign):
        dx, dy = across(e)
        return F.least(sign * dx * (y0 - e["ay"]), sign * dx * (y1 - e["ay"])) - F.greatest(sign * dy * (x0 - e["ax"]), sign * dy * (x1 - e["ax"]))

    e = edges_of(rings)
    few = (F.size(rings) == 1) & (F.size(F.get(rings, F.lit(0))).between(3, 4)) & (x1 > x0)
    return F.coalesce(few & (F.abs(shoelace(rings)) > 0) & (F.forall(e, lambda s: least(s, F.lit(1)) >= 0) | F.forall(e, lambda s: least(s, F.lit(-1)) >= 0)), F.lit(False))
