"""Cross-validation folds as relations: ``assignment(row_id, fold)`` and sparse ``excluded(fold, row_id)``.

Train rows of a fold are all rows without its test rows and its excluded rows, so leave-one-out
methods never hold n lists of n rows.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_order, squared_distance
from .dealing import dealt, tasks_of
from .joins import all_pairs, distance_join, global_rank, knn_join
from .lineage import cut_lineage

log = logging.getLogger("terrastat")


@dataclass
class Folds:
    method: str
    k: int
    assignment: DataFrame
    excluded: DataFrame | None = None
    params: dict = field(default_factory=dict)

    def train(self, fold: int, data: DataFrame) -> DataFrame:
        out = data.join(self.assignment.where(F.col("fold") == fold), "row_id", "left_anti")
        return out if self.excluded is None else out.join(self.excluded.where(F.col("fold") == fold), "row_id", "left_anti")

    def test(self, fold: int, data: DataFrame) -> DataFrame:
        return data.join(self.assignment.where(F.col("fold") == fold), "row_id", "left_semi")


def random_folds(points: DataFrame, k: int, seed: int = 123, order=None) -> Folds:
    """Shuffled contiguous splits; the first ``n mod k`` folds hold one row more."""
    n = points.count()
    if not 2 <= k <= n:
        raise ValueError("k must be at least 2 and at most the number of rows")
    keyed = points.select("row_id", (order if order is not None else hash_order("row_id", seed)).alias("__key"))
    ranked, rank = global_rank(keyed, "__key", "row_id", name="__rank"), F.col("__rank")
    small, more = divmod(n, k)
    fold = F.when(rank < more * (small + 1), F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - more * (small + 1)) / small)) + 1
    return Folds("random_kfold", k, ranked.select("row_id", fold.cast("int").alias("fold")))


def block_dims(width: float, height: float, k: int, nx=None, ny=None, multiplier: float = 3, size: float | None = None) -> tuple[int, int]:
    """Blocks along x and y; a given size wins over counts, counts over the multiple of k."""
    if size:
        nx, ny = max(1, math.floor(width / size)), max(1, math.floor(height / size))
    elif not (nx and ny):
        target = max(1, round(multiplier * k))
        nx = max(1, round(math.sqrt(target * width / height))) if height > 0 else target
        ny = max(1, round(target / nx))
    return nx, ny


def lattice_block(points: DataFrame, nx: int, ny: int, box) -> DataFrame:
    """``row_id, block``: row-major cell of an even grid over the box; a point on an inner edge goes to the lower cell."""
    x0, x1, y0, y1 = box

    def step(c, lo, hi, n):
        t = (F.col(c) - F.lit(lo)) * F.lit(n / (hi - lo)) if hi > lo else F.lit(0.0)
        return F.greatest(F.lit(0), F.least(F.ceil(t) - 1, F.lit(n - 1))).cast("int")

    return points.select("row_id", (step("y", y0, y1, ny) * nx + step("x", x0, x1, nx)).alias("block"))


def lightest_first(sizes: list[tuple[int, int]], k: int) -> dict[int, int]:
    """Blocks by size, largest first, each to the fold with the least load (ties: lower block, lower fold)."""
    load, out = [0] * k, {}
    for block, n in sorted(sizes, key=lambda b: (-b[1], b[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out[block] = f + 1
    if min(load) and max(load) > 3 * min(load):
        log.warning("fold loads are uneven: %s", load)
    return out


def block_folds(
    points: DataFrame, k: int, nx=None, ny=None, multiplier: float = 3, size: float | None = None, box=None,
    auto_range: bool = False, range_frac: float = 1.0, response: str | None = None, predictors=(), drop_empty: bool = True, seed: int = 123,
) -> Folds:
    """Whole blocks of an even grid over the extent (or over ``box``, widened where points lie outside).  Block counts are
    small, rows stay distributed.

    With ``auto_range`` the range of autocorrelation of ``response`` is the block size, unless one is given.
    Empty blocks drop out unless ``drop_empty`` is false, when they count among the blocks that folds need.
    """
    ext = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = ext if box is None else (min(box[0], ext[0]), max(box[1], ext[1]), min(box[2], ext[2]), max(box[3], ext[3]))
    if auto_range and response is None:
        log.warning("auto_range needs a response: blocks by geometry")
    elif auto_range:
        from .autocorr import sac_range

        found = sac_range(points, response, predictors, range_frac=range_frac, seed=seed).value
        if found is None:
            log.warning("no range could be estimated: blocks by geometry")
        elif size is not None and size < found:
            log.warning("blocks of %.1f are smaller than the range of autocorrelation, %.1f", size, found)
        size = found if size is None else size
    nx, ny = block_dims(box[1] - box[0], box[3] - box[2], k, nx, ny, multiplier, size)
    blocks = lattice_block(points, nx, ny, box)
    sizes = [(r["block"], r["n"]) for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not drop_empty:
        seen = {b for b, _ in sizes}
        sizes += [(b, 0) for b in range(nx * ny) if b not in seen]
    if sum(n > 0 for _, n in sizes) < 2:
        raise ValueError("a single block holds all points")
    k = min(k, len(sizes))
    at = lightest_first(sizes, k)
    spark = points.sparkSession
    chosen = spark.createDataFrame(list(at.items()), "block int, fold int")
    return Folds("block_kfold", k, blocks.join(chosen, "block").select("row_id", "fold"), params={"nx": nx, "ny": ny, "blocks": len(sizes)})


def location_folds(points: DataFrame, group: str, k: int | None = None, seed: int = 123, order=None) -> Folds:
    """Whole groups: shuffled groups dealt to the folds in turn; a fold a group where k exceeds their number."""
    g = F.col(group).cast("string")
    if points.where(g.isNull()).limit(1).count():
        raise ValueError("the group column has missing values")
    groups = points.select(g.alias("__g")).distinct()
    n = groups.count()
    if n < 2:
        raise ValueError("leave-location-out needs two groups")
    k = min(k or n, n)
    key = order if order is not None else F.xxhash64(F.lit(int(seed)), F.col("__g"))
    fold = ((F.row_number().over(Window.orderBy(key, "__g")) - 1) % k + 1).cast("int")
    chosen = groups.select("__g", fold.alias("fold"))
    return Folds("leave_location_out", k, points.select("row_id", g.alias("__g")).join(chosen, "__g").select("row_id", "fold"))


def buffered_loo(points: DataFrame, buffer: float) -> Folds:
    """A fold a row; rows no further than the buffer stay out of its train set.  The exclusions are a join inside the
    buffer, so the size of the layer is not limited."""
    n = points.count()
    near = distance_join(points, points, buffer).where("i <> j")
    one = points.select("row_id", F.col("row_id").alias("fold"))
    return Folds("buffered_loo", n, one, near.select(F.col("i").alias("fold"), F.col("j").alias("row_id")), {"buffer": buffer})


def nndm_folds(points: DataFrame, prediction: DataFrame, seed: int = 123, draw=None) -> Folds:
    """A fold a row whose nearest train distance follows the prediction points' distance to the data.

    Each row draws a target radius from those distances (type-7 quantile at ``draw``, uniform in 0..1);
    neighbours nearer than the one closest to the radius are excluded, at least two rows stay.  If any
    neighbour lies within twice the radius, the closest to the radius does: only those are joined, in
    bins for each size of radius; a row without such neighbours takes its nearest.
    """
    n = points.count()
    if n < 3:
        raise ValueError("distance matching takes at least three rows")
    target = knn_join(prediction, points, 1).select("i", "d")
    ranked = global_rank(target, "d", "i", name="rank").select("rank", "d").persist()  # counts and joins below both read it
    m = ranked.count()
    if not m:
        raise ValueError("distance matching takes prediction points")
    u = draw if draw is not None else (F.pmod(hash_order("row_id", seed), F.lit(1_000_003)) + 0.5) / 1_000_003
    # a type-7 quantile: two of the ranked distances, by equi-joins on their ranks
    drawn = points.select(F.col("row_id").alias("i"), ((m - 1) * u).alias("h")).withColumn("low", F.floor("h"))
    low = ranked.select(F.col("rank").alias("low"), F.col("d").alias("__a"))
    high = ranked.select((F.col("rank") - 1).alias("low"), F.col("d").alias("__b"))
    a, b = F.col("__a"), F.coalesce("__b", "__a")
    radius = cut_lineage(drawn.join(low, "low").join(high, "low", "left").select("i", (a + (F.col("h") - F.col("low")) * (b - a)).alias("radius")))
    ranked.unpersist()
    # the size of a radius is a power of two above its double; bins are as wide
    size = F.greatest(F.ceil(F.log2(F.greatest(2 * F.col("radius"), F.lit(1e-12)))), F.lit(-40)).cast("int")
    sizes = [r[0] for r in radius.select(size.alias("s")).distinct().collect()]  # at most some hundred powers of two
    place = lambda c, s: F.floor(F.col(c) / F.pow(F.lit(2.0), s)).cast("long")
    a = points.select(F.col("row_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")).join(radius, "i").withColumn("__s", size)
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = a.withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps))
    a = a.withColumns({"__bx": place("xi", F.col("__s")) + F.col("__dx"), "__by": place("yi", F.col("__s")) + F.col("__dy")}).drop("__dx", "__dy")
    b = points.select(F.col("row_id").alias("j"), "x", "y", F.explode(F.array(*[F.lit(s) for s in sizes]).cast("array<int>")).alias("__s"))
    b = b.withColumns({"__bx": place("x", F.col("__s")), "__by": place("y", F.col("__s"))})
    near = a.join(b, ["__s", "__bx", "__by"]).where("i <> j").withColumn("d", F.sqrt(squared_distance("xi", "yi", "x", "y"))).where("d <= 2 * radius")
    placed = points.select(F.col("row_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")).join(radius, "i")
    best = cut_lineage(_closest_to_radius(placed, points))
    alone = cut_lineage(points.join(best.select(F.col("i").alias("row_id")), "row_id", "left_anti").select("row_id", "x", "y"))
    cut = best.select("i", "radius", F.col("m.d").alias("d"), F.col("m.j").alias("j"), ((F.col("n_near") == n - 1) & (F.col("m.d") == F.col("far"))).alias("__last"))
    # the last of all others may not be it: two rows stay
    last = cut.where("__last").select("i", "radius", F.struct("d", "j").alias("__m")).join(placed.select("i", "xi", "yi"), "i")
    before = all_pairs(last, points.select("row_id", "x", "y")).where("i <> row_id").select("i", "radius", "__m", F.struct(F.sqrt(squared_distance("xi", "yi", "x", "y")).alias("d"), F.col("row_id").alias("j")).alias("o"))
    before = before.groupBy("i").agg(F.first("radius").alias("radius"), F.first("__m").alias("__m"), F.max("o").alias("top"), F.max(F.when(F.col("o") < F.col("__m"), F.col("o"))).alias("lower"))
    before = before.select("i", "radius", F.when((F.col("top") == F.col("__m")) & F.col("lower").isNotNull(), F.col("lower")).otherwise(F.col("__m")).alias("m"))
    chosen = cut.where("not __last").select("i", "radius", "d", "j").unionByName(before.select("i", "radius", F.col("m.d").alias("d"), F.col("m.j").alias("j")))
    if alone.limit(1).count():
        chosen = chosen.unionByName(knn_join(alone, points, 1, exclude_self=True).select("i", "j", "d").join(radius, "i").select("i", "radius", "d", "j"))
    realised = chosen.select("i", "radius", F.col("d").alias("realised"))
    end = chosen.select("i", F.struct("d", "j").alias("__end"))
    excluded = near.select("i", "j", "d").join(end, "i").where(F.struct("d", "j") < F.col("__end")).select(F.col("i").alias("fold"), F.col("j").alias("row_id"))
    return Folds("nndm", n, points.select("row_id", F.col("row_id").alias("fold")), excluded, {"realised": realised})


def _closest_to_radius(placed: DataFrame, points: DataFrame) -> DataFrame:
    """``i, radius, m, n_near, far`` of rows (``i, xi, yi, radius``) with others within twice their radius: of those the one closest to the
    radius (``gap, d, j``; ties by distance and id), how many they are and the farthest of them.  Rows are dealt into blocks that
    meet each other in tasks; only a block's best leave it, not its pairs."""
    blocks = math.ceil(math.sqrt(2 * tasks_of(points.sparkSession)))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    left = placed.select("i", "xi", "yi", "radius", part("i").alias("__l"), each.alias("__r"))
    right = points.select(F.col("row_id").alias("j"), "x", "y", part("row_id").alias("__r"), each.alias("__l"))

    def run(a, b):
        # rows of like radii and places together, so that their neighbours' x span little
        a = a.assign(__s=np.ceil(np.log2(np.maximum(a["radius"], 1e-12)))).sort_values(["__s", "xi"], kind="stable")
        b = b.sort_values("x", kind="stable")
        i, ax, ay, r = a["i"].to_numpy(np.int64), a["xi"].to_numpy(float), a["yi"].to_numpy(float), a["radius"].to_numpy(float)
        j, bx, by = b["j"].to_numpy(np.int64), b["x"].to_numpy(float), b["y"].to_numpy(float)
        out = []
        for at in range(0, len(a), 16):
            part = slice(at, at + 16)
            x, y, reach = ax[part, None], ay[part, None], r[part, None]
            most = 2 * reach.max() * (1 + 1e-12)
            low, high = np.searchsorted(bx, x.min() - most, "left"), np.searchsorted(bx, x.max() + most, "right")
            for k in range(low, high, 4096):
                to = min(k + 4096, high)
                dx, dy = x - bx[k:to], y - by[k:to]
                d = np.sqrt(dx * dx + dy * dy)
                met = (d <= 2 * reach) & (i[part, None] != j[k:to])
                gap = np.where(met, np.abs(d - reach), np.inf)
                least = gap.min(1)
                p, q = np.nonzero((gap == least[:, None]) & met)
                if not len(p):
                    continue
                order = np.lexsort((j[k:to][q], d[p, q], p))
                p, q = p[order], q[order]
                first = np.r_[True, p[1:] != p[:-1]]
                p, q = p[first], q[first]
                out.append((i[part][p], r[part][p], least[p], d[p, q], j[k:to][q], met.sum(1)[p], np.where(met, d, -1.0).max(1)[p]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 7
        return pd.DataFrame(dict(zip(("i", "radius", "gap", "d", "j", "n", "far"), columns)))

    keys = ("__l", "__r")
    a, b = (dealt(side, *keys).groupBy(*keys) for side in (left, right))
    found = a.cogroup(b).applyInPandas(run, "i long, radius double, gap double, d double, j long, n long, far double")
    return found.groupBy("i").agg(F.first("radius").alias("radius"), F.min(F.struct("gap", "d", "j")).alias("m"), F.sum("n").alias("n_near"), F.max("far").alias("far"))


def make_folds(points: DataFrame, k: int | None = None, method: str = "block_kfold", seed: int = 123, **options) -> Folds:
    """Dispatch by method: random_kfold, block_kfold, buffered_loo, leave_location_out, nndm."""
    if method == "random_kfold":
        return random_folds(points, k, seed, **options)
    if method == "block_kfold":
        return block_folds(points, k, seed=seed, **options)
    if method == "buffered_loo":
        return buffered_loo(points, **options)
    if method == "leave_location_out":
        return location_folds(points, k=k, seed=seed, **options)
    if method == "nndm":
        return nndm_folds(points, seed=seed, **options)
    raise ValueError(f"unknown fold method: {method}")


def remap_folds(folds: Folds | None, kept: DataFrame, k: int = 5, seed: int = 123) -> Folds:
    """Folds restricted to surviving rows; a fold without test rows drops out of the assignment.  Without folds, random
    ones of the surviving rows are made, with a warning."""
    if folds is None:
        log.warning("no folds to restrict: random folds are used")
        return random_folds(kept, k, seed)
    ids = kept.select("row_id")
    rest = folds.assignment.join(ids, "row_id", "left_semi")
    gone = None if folds.excluded is None else folds.excluded.join(ids, "row_id", "left_semi").join(rest.select("fold").distinct(), "fold", "left_semi")
    return Folds(folds.method, folds.k, rest, gone, folds.params)
