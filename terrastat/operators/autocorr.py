"""Spatial autocorrelation: neighbour weights, Moran's I, semivariograms and their range."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite, squared_distance
from .joins import knn_join
from .metrics import linear, ols

log = logging.getLogger("terrastat")


def knn_weights(points: DataFrame, k: int = 8) -> DataFrame:
    """Row-standardised edges ``i, j, w``: each point's k nearest others at 1 / k."""
    k = max(1, min(k, points.count() - 1))
    return knn_join(points, points, k, exclude_self=True).select("i", "j", F.lit(1.0 / k).alias("w"))


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """One row ``n, I, expected, variance, z`` of Moran's I of ``row_id, e`` under randomisation.

    Non-finite values drop out with their edges.  Everything is sums over edges: no matrix.  Fewer
    than four values, equal values or no edges leave the statistics they can't give null, with a warning.
    """
    v = values.where(is_finite("e")).select("row_id", F.col("e").cast("double").alias("e"))
    mean, n, low, high = v.agg(F.avg("e"), F.count(F.lit(1)), F.min("e"), F.max("e")).first()
    if n < 4 or low == high:
        log.warning("Moran's I needs four values that differ")
    v = v.select("row_id", (F.col("e") - F.lit(mean)).alias("e")).persist()
    w = weights.join(v.select(F.col("row_id").alias("i"), F.col("e").alias("ei")), "i").join(v.select(F.col("row_id").alias("j"), F.col("e").alias("ej")), "j")
    back = w.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("wt"))
    sums = w.join(back, ["i", "j"], "left").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("ei") * F.col("ej")).alias("cross"), F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("wt", F.lit(0.0))).alias("s1"))
    ends = w.select(F.col("i").alias("p"), "w").unionByName(w.select(F.col("j").alias("p"), "w")).groupBy("p").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    m = v.agg(F.sum(F.col("e") * F.col("e")).alias("q2"), F.sum(F.pow("e", F.lit(4.0))).alias("q4"), F.count(F.lit(1)).cast("double").alias("n"))
    one = m.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(s2))  # single rows
    N, s0, s1, s2c = F.col("n"), F.col("s0"), F.col("s1"), F.col("s2")
    q2 = F.nullif("q2", F.lit(0.0)) if low != high else F.lit(None).cast("double")  # rounding leaves equal values a trace of variance
    s0 = F.nullif("s0", F.lit(0.0))
    b2 = (F.col("q4") / N) / ((q2 / N) * (q2 / N))
    a = N * ((N * N - 3 * N + 3) * s1 - N * s2c + 3 * s0 * s0)
    c = (N * N - N) * s1 - 2 * N * s2c + 6 * s0 * s0
    d = F.nullif((N - 1) * (N - 2) * (N - 3) * s0 * s0, F.lit(0.0))
    free = F.nullif(N - 1, F.lit(0.0))
    out = one.select(F.col("n").cast("long").alias("n"), (N / s0 * F.col("cross") / q2).alias("I"), (-1 / free).alias("expected"), ((a - b2 * c) / d - 1 / (free * free)).alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("I") - F.col("expected")) / F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))))


def p_value(z: float | None, alternative: str = "greater") -> float | None:
    if z is None:
        return None
    upper = 0.5 * math.erfc(z / math.sqrt(2))
    return {"greater": upper, "less": 1 - upper, "two.sided": min(1.0, 2 * min(upper, 1 - upper))}[alternative]


def variogram(points: DataFrame, value: str, cutoff: float, width: float, azimuth: float | None = None, tolerance: float = 22.5) -> DataFrame:
    """Empirical semivariances ``bin, np, dist, gamma`` of pairs up to the cutoff.

    Pairs meet in bins as wide as the cutoff.  ``azimuth`` (degrees from north) keeps pairs whose
    direction, either way, lies within the tolerance.
    """
    from .joins import _around, _binned

    p = points.where(is_finite(value)).select("row_id", "x", "y", F.col(value).cast("double").alias("z"))
    a = _around(p, cutoff).select(F.col("row_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"), "__bx", "__by")
    b = _binned(p, cutoff)
    d = F.sqrt(squared_distance("xi", "yi", "x", "y"))
    pairs = a.join(b, ["__bx", "__by"]).where("i < row_id").select(d.alias("d"), ((F.col("zi") - F.col("z")) * (F.col("zi") - F.col("z"))).alias("sq"), (F.col("x") - F.col("xi")).alias("dx"), (F.col("y") - F.col("yi")).alias("dy"))
    pairs = pairs.where((F.col("d") <= cutoff) & (F.col("d") > 0))
    if azimuth is not None:
        t = math.radians(azimuth)
        along = F.abs(F.col("dx") * math.sin(t) + F.col("dy") * math.cos(t)) / F.col("d")
        pairs = pairs.where(along >= math.cos(math.radians(tolerance)) - 1e-12)
    bins = F.least(F.ceil(F.col("d") / width) - 1, F.lit(max(0, math.ceil(cutoff / width) - 1)))
    return pairs.groupBy(F.greatest(bins, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("np"), F.avg("d").alias("dist"), (F.avg("sq") / 2).alias("gamma"))


def fit_variogram(rows, model: str = "Exp", steps: int = 200):
    """(nugget, psill, range, sse) by weighted least squares (weights np / dist^2) over a range grid with refinement."""
    h, g, n = (np.array([float(r[k]) for r in rows]) for k in ("dist", "gamma", "np"))
    if len(h) < 3:
        return None
    w = n / h**2

    def at(a):
        f = 1 - np.exp(-h / a) if model == "Exp" else np.where(h < a, 1.5 * h / a - 0.5 * (h / a) ** 3, 1.0)
        best = None
        for cols in ((np.ones_like(h), f), (f,), (np.ones_like(h),)):
            x = np.stack(cols, 1) * np.sqrt(w)[:, None]
            beta = np.linalg.lstsq(x, g * np.sqrt(w), rcond=None)[0]
            full = (beta[0], beta[1]) if len(cols) == 2 else (0.0, beta[0]) if cols[0] is f else (beta[0], 0.0)
            if min(full) < 0:
                continue
            sse = float((w * (g - full[0] - full[1] * f) ** 2).sum())
            if best is None or sse < best[2] - 1e-15:
                best = (*map(float, full), sse)
        return best

    grid = np.geomspace(h.min() / 5, h.max() * 3, steps)
    for _ in range(3):
        scored = [(at(a)[2], a) for a in grid if at(a)]
        if not scored:
            return None
        a = min(scored)[1]
        k = int(np.flatnonzero(grid == a)[0])
        grid = np.linspace(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 40)
    nugget, psill, sse = at(a)
    return {"model": model, "nugget": nugget, "psill": psill, "range": float(a), "sse": sse}


@dataclass
class SacRange:
    value: float | None
    directional: bool = False
    anisotropy: float | None = None
    rejected: float | None = None
    model: dict | None = None
    variogram: DataFrame | None = None


def sac_range(points: DataFrame, response: str, predictors=(), n_max: float = 5000, cutoff: float = 0.5, range_frac: float = 1.0, seed: int = 123) -> SacRange:
    """The distance at which a response (or its least-squares residual) decorrelates.

    Too few rows or no fit give no value; a range beyond ``range_frac * cutoff * diagonal`` is
    rejected but reported.  Two directional fits win over the isotropic one; the longer counts.
    """
    p = points.where(is_finite(response))
    if predictors:
        beta = ols(p, response, list(predictors))
        if beta is None:
            return SacRange(None)
        p = p.withColumn("__z", F.col(response) - linear(beta, list(predictors))).where(is_finite("__z"))
    else:
        p = p.withColumn("__z", F.col(response).cast("double"))
    if math.isfinite(n_max):
        p = p.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(int(n_max))
    p = p.persist()
    n, x0, x1, y0, y1 = p.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 30:
        return SacRange(None)
    diagonal = math.hypot(x1 - x0, y1 - y0)
    most = cutoff * diagonal

    def effective(azimuth):
        v = variogram(p, "__z", most, most / 15, azimuth)
        rows = v.collect()  # fifteen bins
        fit = fit_variogram(rows)
        if not fit or not fit["psill"]:  # no exponential structure: a spherical one, whose range is its own
            fit = fit_variogram(rows, "Sph") or fit
        return v, fit, None if not fit or not fit["psill"] else fit["range"] * (3 if fit["model"] == "Exp" else 1)

    sides = [effective(a) for a in (0.0, 90.0)]
    lengths = [s[2] for s in sides if s[2]]
    if len(lengths) == 2:
        v, fit, value = max(sides, key=lambda s: s[2])
        out = SacRange(value, True, max(lengths) / min(lengths), model=fit, variogram=v)
        if out.anisotropy > 1.5:
            log.warning("the range is anisotropic: ratio %.2f", out.anisotropy)
    else:
        v, fit, value = effective(None)
        out = SacRange(value, model=fit, variogram=v)
    if out.value is not None and out.value > range_frac * most:
        out.rejected, out.value = out.value, None
    return out
