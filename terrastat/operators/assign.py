"""Deterministic assignment of points to polygon cells, and summaries by cell."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import nan_to_null, shoelace
from .joins import nearest_join, nearest_polygon, polygon_matches
from .points import polygon_centroid

log = logging.getLogger("terrastat")
ID_NAMES = ("poly_id", "polygon_id", "id", "cell_id", "grid_id")


def with_cell_id(cells: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rename the first known id column to ``cell_id``; number the cells where there is none."""
    for name in ([id_col] if id_col else []) + list(ID_NAMES):
        if name in cells.columns:
            return cells if name == "cell_id" else cells.withColumnRenamed(name, "cell_id")
    return cells.withColumn("cell_id", F.row_number().over(Window.orderBy("xmin", "ymin", "xmax", "ymax")).cast("long"))


def assign_to_cells(points: DataFrame, cells: DataFrame, id_col=None, keep_unassigned=False, predicate="intersects", tie_break="smallest", fallback: str | None = None) -> DataFrame:
    """``points`` with ``cell_id``; among several cells the smallest area wins, then the earlier (lower) id.

    ``tie_break="first"`` takes the lowest id whatever the area.  Points in no cell are dropped, or
    kept with a null id; ``fallback="centroid"`` gives them the cell of the nearest centroid (ties: the lower id).
    """
    if fallback not in (None, "centroid"):
        raise ValueError(f"unknown fallback: {fallback}")
    cells = with_cell_id(cells, id_col)
    sized = cells.withColumn("__area", F.abs(shoelace("rings")))
    met = polygon_matches(points.select("row_id", "x", "y"), sized, predicate=predicate)
    key = F.struct("__area", "cell_id") if tie_break == "smallest" else F.struct("cell_id")
    best = met.groupBy("row_id").agg(F.min(key).alias("__m")).select("row_id", F.col("__m.cell_id").alias("cell_id"))
    if fallback:
        middle = polygon_centroid("rings")
        centroids = cells.select(F.col("cell_id").alias("row_id"), middle["x"].alias("x"), middle["y"].alias("y"))
        rest = points.select("row_id", "x", "y").join(best, "row_id", "left_anti")
        best = best.unionByName(nearest_join(rest, centroids).select(F.col("i").alias("row_id"), F.col("j").alias("cell_id")))
    return points.join(best, "row_id", "left" if keep_unassigned else "inner")


def point_cell_index(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``row_id, cell_id``: the lowest id of the cells that hold a point, else the nearest cell."""
    inside = polygon_matches(points.select("row_id", "x", "y"), cells).groupBy("row_id").agg(F.min("cell_id").alias("cell_id"))
    outside = points.select("row_id", "x", "y").join(inside, "row_id", "left_anti")
    return inside.unionByName(nearest_polygon(outside, cells))


def variogram_correlation(h, structures: list[dict]):
    """Correlation at distance ``h`` under variogram structures (model, psill, range).

    The nugget share lowers it everywhere, distance 0 included; the shape is that of the structure
    with the largest sill, unknown models count as exponential.
    """
    nugget = sum(s["psill"] for s in structures if s["model"] == "Nug")
    rest = [s for s in structures if s["model"] != "Nug"]
    sill = sum(s["psill"] for s in rest)
    if not rest or nugget + sill <= 0:
        return None
    top = max(rest, key=lambda s: s["psill"])
    a = float(top["range"])
    if top["model"] == "Sph":
        shape = F.when(h < a, 1 - 1.5 * h / a + 0.5 * (h / a) * (h / a) * (h / a)).otherwise(0.0)
    elif top["model"] == "Gau":
        shape = F.exp(-(h / a) * (h / a))
    else:
        shape = F.exp(-h / a)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(sill / (nugget + sill)) * shape))


def cell_design_effect(points: DataFrame, structures: list[dict], id_col="cell_id", max_n: int = 500, seed: int = 1, order=None) -> DataFrame:
    """``cell_id, n_used, deff``: 1 + 2 sum of pair correlations / n, within 1 and n; a seeded subset of at most ``max_n`` points a
    cell, as in the reference: the first by ``order``, a shuffle key (default: a hash of the id)."""
    order = Window.partitionBy(id_col).orderBy(F.xxhash64("row_id", F.lit(seed)) if order is None else order, "row_id")
    part = points.select(id_col, "row_id", "x", "y").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= max_n)
    a, b = part.select(id_col, F.col("row_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), part
    h = F.hypot(F.col("xi") - F.col("x"), F.col("yi") - F.col("y"))
    sums = a.join(b, id_col).where("i < row_id").groupBy(id_col).agg(F.sum(variogram_correlation(h, structures)).alias("__s"))
    n = part.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_used"))
    raw = 1 + 2 * F.coalesce("__s", F.lit(0.0)) / F.col("n_used")
    return n.join(sums, id_col, "left").select(id_col, "n_used", F.greatest(F.lit(1.0), F.least(raw, F.col("n_used").cast("double"))).alias("deff"))


def intraclass_correlation(points: DataFrame, columns: list[str], id_col="cell_id") -> float:
    """One-way random-effects ICC of standardised columns, pooled; 0 where it can't be estimated."""
    if not columns:
        return 0.0
    stats = points.agg(*[f(nan_to_null(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    usable = [c for c in columns if stats[f"s_{c}"]]
    if not usable:
        return 0.0
    long = points.select(id_col, F.explode(F.array(*[(nan_to_null(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in usable])).alias("z")).where("z is not null")
    groups = long.groupBy(id_col).agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    total = groups.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("v")).alias("ssw")).first()
    n, k = total["N"] or 0, total["k"]
    if k < 2 or n < 4:
        return 0.0
    mean = total["nm"] / n
    ssb = groups.agg(F.sum(F.col("n") * (F.col("m") - mean) * (F.col("m") - mean))).first()[0]
    n0 = (n - total["q"] / n) / (k - 1)
    if n0 < 1:
        return 0.0
    msb, msw = ssb / (k - 1), total["ssw"] / (n - k) if n > k else 0.0  # cells of one row each leave nothing within
    bottom = msb + (n0 - 1) * msw
    return min(1.0, max(0.0, (msb - msw) / bottom)) if bottom else 0.0


class Vectorised:
    """An aggregate of a user's own: ``function`` takes a pandas Series of a cell's non-missing values and returns a number.

    A cell's values come to one task as one Series, so the largest cell must fit there; built-in aggregates have no such
    bound.
    """

    def __init__(self, function):
        self.function = function

    def column(self, value):
        from pyspark.sql.functions import pandas_udf

        def one(v: pd.Series) -> float:
            v = v[v.notna()]
            out = self.function(v) if len(v) else None
            return None if out is None else float(out)

        return pandas_udf(one, "double")(value)


def _agg_funs(given) -> dict:
    """Named aggregates: a dict or a list of Column functions and ``Vectorised``; what is neither falls back to the mean."""
    if not given:
        return {"mean": F.avg}
    named = dict(given) if isinstance(given, dict) else {f"agg{k + 1}": f for k, f in enumerate(given if isinstance(given, (list, tuple)) else [given])}
    for name, f in named.items():
        if not (callable(f) or isinstance(f, Vectorised)):
            log.warning("%s is no aggregate: the mean is used", name)
            named[name] = F.avg
    return {n or f"agg{k + 1}": f for k, (n, f) in enumerate(named.items())}


def summarize_by_cell(points: DataFrame, response, predictors=(), id_col="cell_id", agg_funs=None, cells: DataFrame | None = None, deff=1.0, structures=None, deff_max_n: int = 500, deff_order=None) -> DataFrame:
    """One row per cell: ``n``, each function of each numeric column, standard deviations and errors, ``cell_weight``.

    ``deff`` is a number (below 1: 1), "kish" (from the intra-class correlation) or "variogram" (from
    ``structures``; of larger cells the first ``deff_max_n`` points by ``deff_order``).  Errors use the non-missing count of their column, ``cell_weight`` the row count.
    ``agg_funs`` are Column functions or ``Vectorised`` ones, by name.  NaN counts as missing.  With ``cells`` every cell has a row; ids are compared as text.
    """
    response = [response] if isinstance(response, str) else list(response)
    numeric = {c for c, t in points.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    roles = [("resp", c) for c in response if c in numeric] + [("pred", c) for c in predictors if c in numeric]
    funs = _agg_funs(agg_funs)
    rho = {}
    if deff == "kish":
        rho = {"resp": intraclass_correlation(points, [c for r, c in roles if r == "resp"], id_col), "pred": intraclass_correlation(points, [c for r, c in roles if r == "pred"], id_col)}
    by_cell = None
    if deff == "variogram":
        if structures and variogram_correlation(F.lit(0.0), structures) is not None:
            by_cell = cell_design_effect(points, structures, id_col, deff_max_n, order=deff_order)
        else:
            log.warning("no variogram model: design effect 1")
    fixed = max(1.0, float(deff)) if isinstance(deff, (int, float)) else 1.0
    aggs = [F.count(F.lit(1)).alias("n")]
    for role, c in roles:
        v = nan_to_null(c)
        aggs += [f(v).alias(f"{role}_{name}_{c}") for name, f in funs.items() if not isinstance(f, Vectorised)]
        aggs += [F.stddev_samp(v).alias(f"__sd_{role}_{c}"), F.count(v).alias(f"__n_{role}_{c}")]
    out = points.groupBy(id_col).agg(*aggs)
    own = [f.column(nan_to_null(c)).alias(f"{role}_{name}_{c}") for role, c in roles for name, f in funs.items() if isinstance(f, Vectorised)]
    if own:  # built-in and user's aggregates can't share one pass
        out = out.join(points.groupBy(F.col(id_col).alias("__own")).agg(*own), F.col(id_col).eqNullSafe(F.col("__own"))).drop("__own")
    if by_cell is not None:
        out = out.join(by_cell.select(id_col, F.col("deff").alias("__deff")), id_col, "left")
    keep = [F.col(id_col), F.col("n")]
    for role, c in roles:
        keep += [F.col(f"{role}_{name}_{c}") for name in funs]
        sd, n = F.col(f"__sd_{role}_{c}"), F.col(f"__n_{role}_{c}")
        effect = F.greatest(F.lit(1.0), 1 + (n - 1) * rho[role]) if rho else F.col("__deff") if by_cell is not None else F.lit(fixed)
        keep += [sd.alias(f"sd_{role}_{c}"), (sd / F.sqrt(n / effect)).alias(f"se_{role}_{c}")]
    if rho:
        r = rho["resp"] if rho["resp"] > 0 else rho["pred"]
        weight = F.col("n") / F.greatest(F.lit(1.0), 1 + (F.col("n") - 1) * r)
    else:
        weight = F.col("n") / (F.col("__deff") if by_cell is not None else F.lit(fixed))
    out = out.select(*keep, weight.cast("double").alias("cell_weight"))
    if cells is not None:
        named = with_cell_id(cells, id_col)
        out = named.join(out.withColumnRenamed(id_col, "__id"), F.col("cell_id").cast("string") == F.col("__id").cast("string"), "left").drop("__id")
    return out
