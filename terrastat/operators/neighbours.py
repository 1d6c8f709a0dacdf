"""k nearest neighbours whose work does not depend on how points cluster.

Few right points are sent to all tasks.  More are packed: in Z-order they are cut into blocks of equally many rows, however
dense a place is, so no block is hot.  A left point takes the k nearest of the block of its own place, which bounds
the distance of its k-th neighbour, and then visits the other blocks whose boxes lie within that distance.  Left points that
meet in one block are dealt over several tasks.  Two rounds do, whatever the data, so plans don't grow.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

SENT_ROWS = 20_000  # right rows of 24 bytes that go to every task: half a megabyte
SENT_PAIRS = 2_000_000_000  # and only while so many distances are fewer than a sort costs
BLOCK_ROWS = 256
MAX_BLOCKS = 200_000  # boxes of 32 bytes that go to every task; more rows make larger blocks
CHUNK = 20_000  # left rows that meet a block in one task
CELLS = 1 << 16  # distances held at once, within a core's cache
BITS = 26

FOUND = "i long, xi double, yi double, home int, j long, d2 double, rank int, r2 double"


def _spread(v: Column) -> Column:
    """Bits of a number of 32 bits, a zero between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column, box) -> Column:
    """The place of points on a Z-shaped curve through the box."""
    x0, x1, y0, y1 = box
    side = max(x1 - x0, y1 - y0) or 1.0
    steps = [F.least(F.greatest(F.floor((c - F.lit(low)) * F.lit((2**BITS - 1) / side)), F.lit(0)), F.lit(2**BITS - 1)).cast("long") for c, low in ((x, x0), (y, y0))]
    return _spread(steps[0]).bitwiseOR(F.shiftleft(_spread(steps[1]), 1))


def _nearest(i, xi, yi, j, x, y, k, exclude_self, limit=None):
    """(left index, right index, d2, rank) of the k nearest right points, ties by the lower id; ``limit`` bounds d2 by row."""
    out = []
    step = max(1, CELLS // max(1, len(j)))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        dx, dy = xi[part, None] - x, yi[part, None] - y
        d2 = dx * dx + dy * dy
        if exclude_self:
            d2[i[part, None] == j] = np.inf
        many = min(k, len(j))
        top = np.partition(d2, many - 1, axis=1)[:, many - 1]
        if limit is not None:
            top = np.minimum(top, limit[part])
        rows, cols = np.nonzero((d2 <= top[:, None]) & np.isfinite(d2))
        d2 = d2[rows, cols]
        order = np.lexsort((j[cols], d2, rows))
        rows, cols, d2 = rows[order], cols[order], d2[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = rank < k
        out.append((rows[keep] + at, cols[keep], d2[keep], rank[keep] + 1))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int)] * 4


def _sent(left: DataFrame, rows: pd.DataFrame, k: int, exclude_self: bool) -> DataFrame:
    sent = left.sparkSession.sparkContext.broadcast((rows["j"].to_numpy(np.int64), rows["x"].to_numpy(float), rows["y"].to_numpy(float)))

    def run(frames):
        j, x, y = sent.value
        for f in frames:
            i = f["i"].to_numpy(np.int64)
            a, b, d2, rank = _nearest(i, f["xi"].to_numpy(float), f["yi"].to_numpy(float), j, x, y, k, exclude_self)
            yield pd.DataFrame({"i": i[a], "j": j[b], "d": np.sqrt(d2), "rank": rank})

    # rows may come in one partition of a small file: the pairs are worth dealing out
    return left.repartition(left.sparkSession.sparkContext.defaultParallelism, "i").mapInPandas(run, "i long, j long, d double, rank int")


class _Boxes:
    """Boxes of blocks, and of runs of as many blocks as there are runs."""

    def __init__(self, boxes: np.ndarray, starts: np.ndarray):
        self.starts = starts
        self.group = max(1, math.isqrt(len(boxes)))
        runs = -(-len(boxes) // self.group)
        far = np.full((runs * self.group - len(boxes), 4), [np.inf, -np.inf, np.inf, -np.inf])  # x0, x1, y0, y1; nothing is near
        self.boxes = np.vstack([boxes, far]).reshape(runs, self.group, 4)
        self.runs = np.column_stack([self.boxes[:, :, 0].min(1), self.boxes[:, :, 1].max(1), self.boxes[:, :, 2].min(1), self.boxes[:, :, 3].max(1)])

    @staticmethod
    def distance2(x, y, box):
        dx = np.maximum(np.maximum(box[..., 0] - x, x - box[..., 1]), 0)
        dy = np.maximum(np.maximum(box[..., 2] - y, y - box[..., 3]), 0)
        return dx * dx + dy * dy

    def close(self, z) -> np.ndarray:
        """The block where each point's place on the curve falls."""
        return np.maximum(np.searchsorted(self.starts, z, "right") - 1, 0)

    @staticmethod
    def farthest2(x, y, box):
        dx = np.maximum(np.abs(x - box[..., 0]), np.abs(x - box[..., 1]))
        dy = np.maximum(np.abs(y - box[..., 2]), np.abs(y - box[..., 3]))
        return dx * dx + dy * dy

    def surest(self, x, y) -> np.ndarray:
        """The block whose farthest corner is nearest to each point: something lies no farther than that."""
        best = np.zeros(len(x), int)
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            r2 = self.farthest2(x[part, None], y[part, None], self.runs).min(1)
            p, block = self.within(x[part], y[part], r2)
            far = self.farthest2(x[part][p], y[part][p], self.boxes.reshape(-1, 4)[block])
            order = np.lexsort((block, far, p))
            first = order[np.r_[True, np.diff(p[order]) > 0]]
            best[p[first] + at] = block[first]
        return best

    def within(self, x, y, r2) -> tuple[np.ndarray, np.ndarray]:
        """(point, block) of all blocks no farther than the points' radii."""
        p, run = np.nonzero(self.distance2(x[:, None], y[:, None], self.runs) <= r2[:, None])
        out = []
        step = max(1, CELLS // self.group)
        for at in range(0, len(p), step):
            q, r = p[at : at + step], run[at : at + step]
            a, b = np.nonzero(self.distance2(x[q, None], y[q, None], self.boxes[r]) <= r2[q, None])
            out.append((q[a], r[a] * self.group + b))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def spread_crowds(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__part`` beside their block: a block that many left rows visit is copied to as many tasks as they fill."""
    crowds = left.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("__parts"))
    crowds = cut_lineage(crowds.where("__parts > 1"))  # none, as a rule
    dealt = left.join(F.broadcast(crowds), "block", "left").withColumn("__part", F.pmod(F.xxhash64(key), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    copies = right.join(F.broadcast(crowds), "block", "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - F.lit(1).cast("long")))).drop("__parts")
    return dealt, copies


def blocked(rows: DataFrame, xs: list[str], ys: list[str], *ids: str) -> tuple[DataFrame, _Boxes]:
    """``rows`` with their ``block``, as many in each, along a Z-order of the means of ``xs`` and ``ys``; and the blocks' boxes
    (at most ``MAX_BLOCKS``), which hold all these columns."""
    from .joins import global_rank

    low = [F.least(*c) if len(c) > 1 else F.col(c[0]) for c in (xs, ys)]
    high = [F.greatest(*c) if len(c) > 1 else F.col(c[0]) for c in (xs, ys)]
    *box, m = rows.agg(F.min(low[0]), F.max(high[0]), F.min(low[1]), F.max(high[1]), F.count(F.lit(1))).first()
    size = max(BLOCK_ROWS, -(-m // MAX_BLOCKS))
    place = z_order((low[0] + high[0]) / 2, (low[1] + high[1]) / 2, box)
    ranked = global_rank(rows.withColumn("__z", place), "__z", *ids, name="__rank")
    out = cut_lineage(ranked.withColumn("block", F.least(F.floor(F.col("__rank") / size), F.lit(max(0, m // size - 1))).cast("int")).drop("__rank"))
    found = out.groupBy("block").agg(F.min(low[0]), F.max(high[0]), F.min(low[1]), F.max(high[1]), F.min("__z").alias("z")).toPandas().sort_values("block")
    return out.drop("__z"), _Boxes(found.iloc[:, 1:5].to_numpy(float), found["z"].to_numpy(np.int64))


def _visit(left: DataFrame, right: DataFrame, k: int, exclude_self: bool, tasks: int) -> DataFrame:
    """``FOUND`` of left rows (``i, xi, yi, home, block, r2``) in their blocks.  A block that many left rows visit is copied
    to as many tasks as they fill.  The number of tasks is given: rows are few bytes for the work they are, so by their size they
    would be joined into few tasks."""
    dealt, copies = spread_crowds(left, right, "i")

    def run(a, b):
        i, xi, yi = a["i"].to_numpy(np.int64), a["xi"].to_numpy(float), a["yi"].to_numpy(float)
        limit = a["r2"].to_numpy(float)
        j = b["j"].to_numpy(np.int64)
        p, q, d2, rank = _nearest(i, xi, yi, j, b["x"].to_numpy(float), b["y"].to_numpy(float), k, exclude_self, limit)
        reach = np.full(len(i), np.inf)
        last = rank == k
        reach[p[last]] = d2[last]
        return pd.DataFrame({"i": i[p], "xi": xi[p], "yi": yi[p], "home": a["home"].to_numpy()[p], "j": j[q], "d2": d2, "rank": rank, "r2": reach[p]})

    a, b = (side.repartition(tasks, "block", "__part").groupBy("block", "__part") for side in (dealt, copies))
    return a.cogroup(b).applyInPandas(run, FOUND)


def _packed(left: DataFrame, right: DataFrame, box, n_left: int, k: int, exclude_self: bool) -> DataFrame:
    from .joins import global_rank

    enough = k + 1 if exclude_self else k
    # of points in one place those of the lowest ids serve all; the limit is applied before the shuffle, too
    place = Window.partitionBy("x", "y").orderBy("j")
    some = right.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= enough).drop("__n")
    some = cut_lineage(some.withColumn("__z", z_order(F.col("x"), F.col("y"), box)))
    m = some.count()
    size = max(BLOCK_ROWS, 2 * enough, -(-m // MAX_BLOCKS))
    last = max(0, m // size - 1)
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(last + 1, n_left * size // 50_000_000))
    blocks = global_rank(some, "__z", "x", "y", "j", name="__rank").select("j", "x", "y", "__z", F.least(F.floor(F.col("__rank") / size), F.lit(last)).cast("int").alias("block"))
    blocks = cut_lineage(blocks)
    found = blocks.groupBy("block").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("__z").alias("z")).toPandas().sort_values("block")  # at most MAX_BLOCKS rows
    sent = left.sparkSession.sparkContext.broadcast(_Boxes(found.iloc[:, 1:5].to_numpy(float), found["z"].to_numpy(np.int64)))
    blocks, left = blocks.drop("__z"), left.withColumn("__z", z_order(F.col("xi"), F.col("yi"), box))

    def homes(frames):
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048]
                block = sent.value.close(g["__z"].to_numpy(np.int64))
                yield pd.DataFrame({"i": g["i"], "xi": g["xi"], "yi": g["yi"], "home": block, "block": block, "r2": np.inf})

    def others(frames):
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048].reset_index(drop=True)
                r2 = g["r2"].to_numpy(float)
                p, block = sent.value.within(g["xi"].to_numpy(float), g["yi"].to_numpy(float), r2)
                keep = block != g["home"].to_numpy()[p]
                p, block = p[keep], block[keep]
                yield pd.DataFrame({"i": g["i"].to_numpy()[p], "xi": g["xi"].to_numpy()[p], "yi": g["yi"].to_numpy()[p], "home": g["home"].to_numpy()[p], "block": block, "r2": r2[p]})

    visit = "i long, xi double, yi double, home int, block int, r2 double"
    first = cut_lineage(_visit(cut_lineage(left.mapInPandas(homes, visit)), blocks, k, exclude_self, tasks))
    more = _visit(cut_lineage(first.where("rank = 1").mapInPandas(others, visit)), blocks, k, exclude_self, tasks)
    both = first.select("i", "j", "d2").unionByName(more.select("i", "j", "d2"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", F.sqrt("d2").alias("d"), "rank")


def knn_join(left: DataFrame, right: DataFrame, k: int, exclude_self: bool = False, sent_rows: int | None = None) -> DataFrame:
    """``i, j, d, rank``: the k nearest right points of each left point (``row_id, x, y``); ties by the lower id.

    ``exclude_self`` leaves out a point of the same id.  ``k`` is cut to the points there are.  Points without finite
    coordinates have no neighbours and are none; no right points give no rows.  Up to ``sent_rows`` right points are
    broadcast (default ``SENT_ROWS``) if the pairs are few, more are packed into blocks.
    """
    from ..functions.exprs import all_finite

    a = left.where(all_finite(["x", "y"])).select(F.col("row_id").cast("long").alias("i"), F.col("x").cast("double").alias("xi"), F.col("y").cast("double").alias("yi"))
    b = right.where(all_finite(["x", "y"])).select(F.col("row_id").cast("long").alias("j"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    *box, n = b.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    most = n - 1 if exclude_self else n
    if most < 1:
        return left.sparkSession.createDataFrame([], "i long, j long, d double, rank int")
    k = max(1, min(k, most))
    n_left = a.count()
    if n <= (SENT_ROWS if sent_rows is None else sent_rows) and n * n_left <= SENT_PAIRS:
        return _sent(a, b.toPandas(), k, exclude_self)
    return _packed(a, b, box, n_left, k, exclude_self)
