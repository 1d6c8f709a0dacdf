"""Spatial joins as bin-keyed equi-joins.

Catalyst plans a join on inequalities as a nested loop; every join here first meets on integer bin
keys, so it stays a hash or sort-merge join, and the geometry is a residual condition.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import edges_of, point_in_edges, squared_distance
from .dealing import dealt, tasks_of
from .lineage import cut_lineage
from .neighbours import CELLS, blocked, knn_join, spread_crowds


def _bin(c, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def _around(df: DataFrame, width: float, reach: int = 1) -> DataFrame:
    """A row for each bin within ``reach`` bins of a point."""
    steps = F.array(*[F.lit(k) for k in range(-reach, reach + 1)])
    out = df.withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps))
    return out.withColumns({"__bx": _bin(F.col("x"), width) + F.col("__dx"), "__by": _bin(F.col("y"), width) + F.col("__dy")}).drop("__dx", "__dy")


def _binned(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({"__bx": _bin(F.col("x"), width), "__by": _bin(F.col("y"), width)})


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 0) of each row in a total order, without sorting all rows in one task: rows are dealt
    out by ranges, numbered inside them, and the ranges' counts are summed."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = dealt.withColumn("__inner", inner).join(F.broadcast(counts), F.col("__part") == F.col("__p"))  # a row per partition
    return ranked.withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__p", "__before", "__inner")


def quantiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """Type-7 quantiles of a column's non-missing values.  Values are ranked over ranges, no task sees them all; nulls without
    values."""
    rows = global_rank(df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)"), "v", name="__rank")
    n = rows.count()
    if not n:
        return [None] * len(at)
    place = [p * (n - 1) for p in at]
    need = sorted({int(k) for h in place for k in (math.floor(h), min(math.floor(h) + 1, n - 1))})
    found = dict(rows.where(F.col("__rank").isin(need)).select("__rank", "v").collect())  # two rows a quantile
    return [found[math.floor(h)] + (h - math.floor(h)) * (found[min(math.floor(h) + 1, n - 1)] - found[math.floor(h)]) for h in place]


def edge_distance2(x, y, edge) -> Column:
    """Squared distance of a point to an edge (``ax, ay, bx, by``)."""
    dx, dy = edge["bx"] - edge["ax"], edge["by"] - edge["ay"]
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - edge["ax"]) * dx + (y - edge["ay"]) * dy) / length2))).otherwise(0.0)
    return squared_distance(x, y, edge["ax"] + t * dx, edge["ay"] + t * dy)


def polygon_matches(points: DataFrame, cells: DataFrame, bin_width: float | None = None, predicate="intersects", distance: float = 0.0) -> DataFrame:
    """Pairs of points (``row_id, x, y``) and cells (``cell_id, rings, xmin, ymin, xmax, ymax``) that meet.

    Closed cells for ``intersects``; ``within`` leaves out points on a cell's edge; ``within_distance``
    adds the points no further from a cell than ``distance``.  A predicate of the user's own is a function of the columns x, y
    and edges (``ax, ay, bx, by``) that gives a condition; points no further than ``distance`` from a cell's box are tried.  The bin width defaults to the mean cell
    side, so a cell spans a few bins whatever the extent.
    """
    reach = float(distance) if predicate == "within_distance" or callable(predicate) else 0.0
    if bin_width is None:
        side = cells.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0]
        bin_width = max(side or 1.0, reach)
    spread = cells.select("cell_id", "xmin", "ymin", "xmax", "ymax", edges_of("rings").alias("__edges"), *[c for c in cells.columns if c.startswith("__") and c != "__edges"])
    spread = spread.withColumn("__bx", F.explode(F.sequence(_bin(F.col("xmin") - reach, bin_width), _bin(F.col("xmax") + reach, bin_width))))
    spread = spread.withColumn("__by", F.explode(F.sequence(_bin(F.col("ymin") - reach, bin_width), _bin(F.col("ymax") + reach, bin_width))))
    met = _binned(points, bin_width).join(spread, ["__bx", "__by"])
    met = met.where(F.col("x").between(F.col("xmin") - reach, F.col("xmax") + reach) & F.col("y").between(F.col("ymin") - reach, F.col("ymax") + reach))
    if callable(predicate):
        return met.where(predicate(F.col("x"), F.col("y"), F.col("__edges"))).drop("__bx", "__by", "__edges")
    inside = point_in_edges("x", "y", "__edges")
    if predicate == "within_distance":
        met = met.where(inside | F.exists("__edges", lambda e: edge_distance2(F.col("x"), F.col("y"), e) <= reach * reach))
        return met.drop("__bx", "__by", "__edges")
    met = met.where(inside)
    if predicate == "within":
        strict = ~F.exists("__edges", lambda e: ((e["bx"] - e["ax"]) * (F.col("y") - e["ay"]) == (e["by"] - e["ay"]) * (F.col("x") - e["ax"])) & F.col("x").between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & F.col("y").between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
        met = met.where(strict)
    elif predicate != "intersects":
        raise ValueError(f"unknown predicate: {predicate}")
    return met.drop("__bx", "__by", "__edges")


def distance_join(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """``i, j, d`` for ids of points (``row_id, x, y``) no further apart than ``reach``, equal ids included.

    Bins as wide as ``reach`` form tiles of four by four.  A left row is sent to its tile's partition, a right row to those of the
    tiles that its bin and the bins beside it are in, 2.25 on average; tiles next to each other are in different partitions.  The nine
    bins around a left row are made where it was sent to, so they are never on disk.
    """
    if not reach > 0:
        raise ValueError("the distance must be positive")
    parts = 4 * tasks_of(left.sparkSession)  # narrow rows, but many pairs
    tile = lambda c, step=0: F.shiftright(_bin(F.col(c), reach) + F.lit(step).cast("long"), 2)
    part = lambda tx, ty: F.pmod(F.pmod(tx, F.lit(parts)) * 7919 + F.pmod(ty, F.lit(parts)), F.lit(parts)).cast("int")
    near = F.array_distinct(F.array(*[part(tile("x", i), tile("y", j)) for i in (-1, 1) for j in (-1, 1)]))
    a = left.select(F.col("row_id").alias("i"), "x", "y", part(tile("x"), tile("y")).alias("__part")).repartitionById(parts, "__part")
    b = right.select(F.col("row_id").alias("j"), "x", "y", F.explode(near).alias("__part")).repartitionById(parts, "__part")
    a = _around(a, reach).select("i", F.col("x").alias("xi"), F.col("y").alias("yi"), "__part", "__bx", "__by")
    d2 = squared_distance("xi", "yi", "x", "y")
    return a.join(_binned(b, reach), ["__bx", "__by", "__part"]).where(d2 <= F.lit(float(reach)) * F.lit(float(reach))).select("i", "j", F.sqrt(d2).alias("d"))


def nearest_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, d``: the nearest right point of each left point; ties by the lower id."""
    return knn_join(left, right, 1).drop("rank")


def nearest_polygon(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``row_id, cell_id``: for each point the cell nearest to it by distance to its edges; ties by the lower id.

    Edges are packed into blocks of equally many rows.  A point tries the block that is surest to be near, which bounds its
    distance, and then the other blocks no farther than that: its work does not grow with its distance from all cells.
    """
    left = cut_lineage(points.select(F.col("row_id").alias("i"), "x", "y"))
    schema = "i long, x double, y double, home int, d double, cell_id long"
    flat = cells.select("cell_id", F.explode(edges_of("rings")).alias("e")).select("cell_id", *[F.col(f"e.{c}").alias(c) for c in ("ax", "ay", "bx", "by")])
    if not left.limit(1).count() or not flat.limit(1).count():
        return points.select("row_id", F.lit(None).cast("long").alias("cell_id")).limit(0)
    edges, boxes = blocked(flat, ["ax", "bx"], ["ay", "by"], "ax", "ay", "bx", "by", "cell_id")
    spark = points.sparkSession
    sent, tasks = spark.sparkContext.broadcast(boxes), tasks_of(spark)

    def first(frames):
        for f in frames:
            block = sent.value.surest(f["x"].to_numpy(float), f["y"].to_numpy(float))
            yield pd.DataFrame({"i": f["i"], "x": f["x"], "y": f["y"], "home": block, "block": block})

    def others(frames):
        for f in frames:
            for at in range(0, len(f), 2048):
                g = f.iloc[at : at + 2048].reset_index(drop=True)
                p, block = sent.value.within(g["x"].to_numpy(float), g["y"].to_numpy(float), np.square(g["d"].to_numpy(float)) * (1 + 1e-12))
                keep = block != g["home"].to_numpy()[p]
                yield g.loc[p[keep], ["i", "x", "y", "home"]].assign(block=block[keep])

    def nearest(a, b):
        x, y, ids = a["x"].to_numpy(float), a["y"].to_numpy(float), b["cell_id"].to_numpy(np.int64)
        ax, ay, bx, by = (b[c].to_numpy(float) for c in ("ax", "ay", "bx", "by"))
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        d, cell = np.empty(len(x)), np.empty(len(x), np.int64)
        step = max(1, CELLS // len(ids))
        for at in range(0, len(x), step):
            px, py = x[at : at + step, None], y[at : at + step, None]
            t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
            far = np.sqrt(np.square(px - (ax + t * dx)) + np.square(py - (ay + t * dy)))
            d[at : at + step] = far.min(1)
            cell[at : at + step] = np.where(far == d[at : at + step, None], ids, np.iinfo(np.int64).max).min(1)
        return a[["i", "x", "y", "home"]].assign(d=d, cell_id=cell)

    def visit(made):
        a, b = (side.repartition(tasks, "block", "__part").groupBy("block", "__part") for side in spread_crowds(made, edges, "i"))
        return a.cogroup(b).applyInPandas(nearest, schema)

    visits = "i long, x double, y double, home int, block int"
    found = cut_lineage(visit(dealt(left, "i").mapInPandas(first, visits)))
    more = visit(cut_lineage(dealt(found, "i").mapInPandas(others, visits)))
    both = found.select("i", "d", "cell_id").unionByName(more.select("i", "d", "cell_id"))
    return both.groupBy("i").agg(F.min(F.struct("d", "cell_id")).alias("m")).select(F.col("i").alias("row_id"), F.col("m.cell_id").alias("cell_id"))


def grow_nearest(left: DataFrame, spread, value: Column, width: float, box, where: Column | None = None) -> DataFrame:
    """``i, m``: for each left point (``i, x, y``, payload) the least ``value``, a struct whose ``d`` is a distance not below
    that in the plane.  ``spread(width)`` gives the right side in bins (``__bx, __by``); the sides are aliased a and
    b for ``value`` and the condition ``where``.  Points meet in 3 x 3
    bins; those whose least distance those bins are not sure to cover are tried again with bins four times as wide."""
    x0, x1, y0, y1 = box
    ext = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(x1 - x0, y1 - y0, 1e-9)
    if ext[0] is not None:
        span = max(span, abs(ext[0] - x1), abs(ext[1] - x0), abs(ext[2] - y1), abs(ext[3] - y0))
    todo, done = left, None
    while True:
        # narrow rows, but many pairs: by their bytes they would meet in few tasks
        a, b = dealt(_around(todo, width), "__bx", "__by"), dealt(spread(width), "__bx", "__by")
        met = a.alias("a").join(b.alias("b"), ["__bx", "__by"])
        if where is not None:
            met = met.where(where)
        best = met.groupBy("i").agg(F.min(value).alias("m"))
        if width > span:
            return best if done is None else done.unionByName(best)
        best = cut_lineage(best.where(F.col("m.d") <= width))
        done = best if done is None else done.unionByName(best)
        todo = todo.join(best.select("i"), "i", "left_anti")
        if not todo.limit(1).count():
            return done
        width *= 4


def all_pairs(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Every left row with every right row, for work that is over all pairs by its nature: the right side is dealt into
    parts that each left row meets in turn, so the pairs are spread over tasks by an equi-join."""
    parts = parts or left.sparkSession.sparkContext.defaultParallelism * 4
    dealt = right.withColumn("__part", F.pmod(F.xxhash64("row_id"), F.lit(parts)))
    return left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, "__part").drop("__part")
