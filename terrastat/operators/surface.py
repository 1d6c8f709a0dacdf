"""Prediction surfaces over a grid, and plot specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_finite
from ..sources.layer import prediction_grid
from .joins import nearest_join, polygon_matches
from .models import GPFit, SpatialFit


def nearest_covariates(grid: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Grid points with the columns of their nearest source point."""
    near = nearest_join(grid, source).select(F.col("i").alias("row_id"), "j")
    return grid.join(near, "row_id").join(source.select(F.col("row_id").alias("j"), *columns), "j").drop("j")


def predict_surface(fit: SpatialFit, grid: DataFrame | None = None, cell_size=None, n_cells: int = 10_000, boundary: DataFrame | None = None, covariates: DataFrame | None = None, se: bool = False) -> DataFrame:
    """The grid's rows with ``pred`` (and ``pred_se`` of models with draws).  Predictors the grid lacks come from the nearest covariate point."""
    if grid is None:
        box = fit.data.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        grid = prediction_grid(fit.data.sparkSession, box, cell_size, n_cells)
    if boundary is not None:
        grid = grid.join(polygon_matches(grid.select("row_id", "x", "y"), boundary).select("row_id").distinct(), "row_id", "left_semi")
        if not grid.limit(1).count():
            raise ValueError("no grid point lies in the boundary")
    missing = [c for c in fit.predictors if c not in grid.columns]
    if missing:
        if covariates is None:
            raise ValueError(f"the grid lacks {missing} and no covariates are given")
        grid = nearest_covariates(grid, covariates, missing)
    if se and isinstance(fit, GPFit):
        d = fit.predict(grid, draws=True)
        mean = F.aggregate("draws", F.lit(0.0), lambda s, v: s + v) / F.size("draws")
        d = d.withColumn("__m", mean)
        var = F.aggregate("draws", F.lit(0.0), lambda s, v: s + (v - F.col("__m")) * (v - F.col("__m"))) / (F.size("draws") - 1)
        return grid.join(d.select("row_id", "pred", F.sqrt(var).alias("pred_se")), "row_id")
    return grid.join(fit.predict(grid), "row_id")


def svg_map(cells: DataFrame, fill: str | None = None, width: int = 600, max_cells: int = 20_000) -> str:
    """An SVG drawing of a tessellation, shaded by a column."""
    rows = cells.select("rings", *([fill] if fill else [])).limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError(f"at most {max_cells} cells are drawn")
    pts = [(p["x"], p["y"]) for r in rows for ring in r["rings"] for p in ring]
    x0, x1, y0, y1 = min(p[0] for p in pts), max(p[0] for p in pts), min(p[1] for p in pts), max(p[1] for p in pts)
    scale = width / ((x1 - x0) or 1)
    vals = [r[fill] for r in rows if fill and r[fill] is not None]
    lo, hi = (min(vals), max(vals)) if vals else (0, 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{(y1 - y0) * scale:.0f}">']
    for r in rows:
        v = r[fill] if fill else None
        shade = 230 if v is None else int(230 - 180 * ((v - lo) / ((hi - lo) or 1)))
        path = "".join("M" + "L".join(f"{(p['x'] - x0) * scale:.2f},{(y1 - p['y']) * scale:.2f}" for p in ring) + "Z" for ring in r["rings"])
        out.append(f'<path d="{path}" fill="rgb({shade},{shade},230)" stroke="#333" fill-rule="evenodd"/>')
    return "\n".join([*out, "</svg>"])


PALETTE = ("#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666")


def _raster(points: DataFrame, x: str, y: str, columns: int, *aggregates):
    """(rows of ``px, py, n`` and aggregates, box): points added up by the pixels of a grid, at most columns x columns rows."""
    known = points.where(all_finite([x, y]))
    x0, x1, y0, y1 = known.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if x0 is None:
        return [], None
    side = max(x1 - x0, y1 - y0) or 1.0
    at = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) * F.lit(columns / side)), F.lit(columns - 1)).cast("int")
    found = known.withColumns({"px": at(x, x0), "py": at(y, y0)}).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return found.collect(), (x0, x1, y0, y1, side)


def _dots(rows, box, columns: int, width: int, colour) -> list[str]:
    step, high = width / columns, width * (box[3] - box[2]) / box[4]
    most = max((r["n"] for r in rows), default=1)
    return [f'<circle cx="{(r["px"] + 0.5) * step:.2f}" cy="{max(high, step) - (r["py"] + 0.5) * step:.2f}" r="{step * (0.25 + 0.25 * r["n"] / most):.2f}" fill="{colour(r)}"/>' for r in rows]


def _svg(body: list[str], width: int, height: float, title: str) -> str:
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height:.0f}"><title>{title}</title>', *body, "</svg>"])


def plot_folds(folds, points: DataFrame, width: int = 600, columns: int = 80) -> str:
    """An SVG map of the test rows of folds.  All rows count: each pixel shows its most frequent fold (ties: the lower one),
    a larger dot for more rows.  Folds repeat a palette of eight colours."""
    labelled = points.select("row_id", "x", "y").join(folds.assignment, "row_id")
    x0 = labelled.agg(F.min("x")).first()[0]
    if x0 is None:
        return _svg([], width, 0, folds.method)
    rows, box = _raster(labelled, "x", "y", columns, F.mode("fold", True).alias("fold"))
    body = _dots(rows, box, columns, width, lambda r: PALETTE[(int(r["fold"]) - 1) % len(PALETTE)])
    return _svg(body, width, max(width * (box[3] - box[2]) / box[4], width / columns), f"{folds.method}, {folds.k} folds")


def plot_fit(fit: SpatialFit, what: str = "observed", width: int = 600, columns: int = 60) -> str:
    """An SVG of a fit over all its rows: ``observed`` against fitted values with the line of equality, or a map of
    ``residuals``, red above and blue below the fit."""
    if what not in ("observed", "residuals"):
        raise ValueError("what is observed or residuals")
    d = fit.data.join(fit.fitted(), "row_id").select("row_id", "x", "y", F.col(fit.response).cast("double").alias("o"), F.col("pred").alias("p"))
    if what == "observed":
        rows, box = _raster(d, "p", "o", columns)
        if box is None:
            return _svg([], width, 0, str(fit.engine))
        high = max(width * (box[3] - box[2]) / box[4], width / columns)
        scale = width / box[4]
        line = f'<line x1="{(box[2] - box[0]) * scale:.2f}" y1="{high:.2f}" x2="{(box[3] - box[0]) * scale:.2f}" y2="0" stroke="#999"/>'
        return _svg([line, *_dots(rows, box, columns, width, lambda r: "#333")], width, high, f"{fit.engine}: observed against fitted")
    rows, box = _raster(d.where(all_finite(["o", "p"])), "x", "y", columns, F.avg(F.col("o") - F.col("p")).alias("e"))
    if box is None:
        return _svg([], width, 0, str(fit.engine))
    top = max((abs(r["e"]) for r in rows), default=0.0) or 1.0

    def colour(r):
        faded = int(235 * (1 - min(1.0, abs(r["e"]) / top)))
        return f"rgb(235,{faded},{faded})" if r["e"] > 0 else f"rgb({faded},{faded},235)"

    return _svg(_dots(rows, box, columns, width, colour), width, max(width * (box[3] - box[2]) / box[4], width / columns), f"{fit.engine}: residuals")
