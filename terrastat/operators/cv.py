"""Cross-validation, comparison and selection of models."""

from __future__ import annotations

import inspect
import logging
import math
import zlib
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_finite
from .folds import Folds, make_folds
from .metrics import covered, crps_energy, moments, regression_metrics, solve_moments
from .models import SpatialFit, fit_forest, fit_gp, fit_gwr

log = logging.getLogger("terrastat")


def fold_metrics(preds: DataFrame) -> DataFrame:
    """RMSE, MAE and R2 by fold of ``row_id, fold, y, yhat, y_train_mean``; R2 is against the train mean."""
    e, b = F.col("y") - F.col("yhat"), F.col("y") - F.col("y_train_mean")
    m = preds.where(all_finite(["y", "yhat"])).groupBy("fold").agg(F.count(F.lit(1)).alias("n_pred"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), F.sum(e * e).alias("rss"), F.sum(b * b).alias("tss"))
    return m.select("fold", "n_pred", "RMSE", "MAE", (1 - F.col("rss") / F.nullif("tss", F.lit(0.0))).alias("R2"))


def overall_metrics(preds: DataFrame) -> DataFrame:
    """Pooled metrics; each row's baseline is its own fold's train mean, Adj_R2 stays null."""
    return regression_metrics(preds, "y", "yhat", None, "y_train_mean")


def cv_ols(data: DataFrame, response: str, predictors: list[str], folds: Folds) -> DataFrame:
    """Out-of-fold predictions ``row_id, fold, y, yhat, y_train_mean`` of least squares, without refitting.

    Each fold's train sums are the total less its test and excluded rows' sums: one aggregate for all
    folds.  Columns are centred by their global means first, since subtraction would cancel otherwise.
    """
    clean = data.where(all_finite([response, *predictors]))
    names = [response, *predictors]
    mean = clean.agg(*[F.avg(c).alias(c) for c in names]).first()
    z = clean.select("row_id", *[(F.col(c) - mean[c]).alias(c) for c in names])
    total = moments(z, response, predictors).first()
    held = z.join(folds.assignment, "row_id")
    gone = held if folds.excluded is None else held.unionByName(z.join(folds.excluded, "row_id"))
    rows = moments(gone, response, predictors, ["fold"]).collect()  # a row per fold
    p, out = len(predictors), []
    for r in rows:
        left = {k: total[k] - r[k] for k in total.asDict()}
        beta = solve_moments(left, p)
        if beta is not None:
            out.append((int(r["fold"]), [float(b) for b in beta], float(left[f"s0_{p + 1}"] / left["s0_0"])))
    if not out:
        log.warning("no fold could be fitted")
    coef = data.sparkSession.createDataFrame(out, "fold int, beta array<double>, m double")
    yhat = F.get("beta", F.lit(0))
    for k, c in enumerate(predictors):
        yhat = yhat + F.get("beta", F.lit(k + 1)) * F.col(c)
    y = F.col(response)
    return held.withColumn("fold", F.col("fold").cast("int")).join(coef, "fold").select("row_id", "fold", (y + mean[response]).alias("y"), (yhat + mean[response]).alias("yhat"), (F.col("m") + mean[response]).alias("y_train_mean"))


def filter_args(fun, args: dict) -> dict:
    """Those of ``args`` that a function takes by name."""
    takes = inspect.signature(fun).parameters
    if any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return dict(args)
    return {k: v for k, v in args.items() if k in takes}


def fold_seed(seed: int, fold: int) -> int:
    """The seed of a fold: it depends on (seed, fold) alone, so order and parallel runs change nothing."""
    return zlib.crc32(f"{seed}:{fold}".encode())


def cv_spatial(data: DataFrame, response: str, folds: Folds, fit_fn, info_fn=None, predict_args: dict | None = None, parallel: int = 1) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(overall, predictions, extras) of any ``fit_fn(train) -> SpatialFit``; folds that fail are left out with a warning.

    ``fit_fn`` may also take ``fold``; ``info_fn(fit)``, which gives a fold's extras, may also take ``test``, ``y`` and
    ``yhat`` (column names of ``preds``) and ``preds``.  ``predict_args`` go to ``predict``.  ``parallel`` folds are
    run at once, each as Spark jobs of its own; results are the same.
    """
    def one(fold):
        train, test = folds.train(fold, data), folds.test(fold, data)
        n_train, mean = train.agg(F.count(F.lit(1)), F.avg(response)).first()
        if n_train < 2 or not test.limit(1).count():
            return None
        try:
            fit = fit_fn(train, **filter_args(fit_fn, {"fold": fold})) if "fold" in inspect.signature(fit_fn).parameters else fit_fn(train)
            if not isinstance(fit, SpatialFit):
                raise TypeError("fit_fn must return a SpatialFit")
            p = test.join(fit.predict(test, **(predict_args or {})), "row_id").select("row_id", F.lit(fold).alias("fold"), F.col(response).cast("double").alias("y"), F.col("pred").alias("yhat"), F.lit(mean).alias("y_train_mean"))
            more = info_fn(fit, **filter_args(info_fn, {"test": test, "preds": p, "y": "y", "yhat": "yhat"})) if info_fn else {}
        except Exception as e:
            log.warning("fold %s failed: %s", fold, e)
            return None
        return p, {"fold": fold, "n_train": n_train} | more

    ids = [f for (f,) in folds.assignment.select("fold").distinct().orderBy("fold").collect()]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        done = [x for x in pool.map(one, ids) if x]
    if not done:
        raise ValueError("no fold could be fitted")
    preds = reduce(DataFrame.unionByName, [p for p, _ in done])
    return overall_metrics(preds), preds, [x for _, x in done]


def cv_gwr(data, response, predictors, folds: Folds | None = None, k: int = 5, **options):
    folds = folds or make_folds(data, k)
    return cv_spatial(data, response, folds, lambda t: fit_gwr(t, response, predictors, **options), lambda f: {"bandwidth": f.info["bandwidth"]})


def cv_forest(data, response, predictors, folds: Folds | None = None, k: int = 5, seed: int = 123, **options):
    folds = folds or make_folds(data, k)
    return cv_spatial(data, response, folds, lambda t, fold: fit_forest(t, response, predictors, seed=fold_seed(seed, fold), **options))


def cv_gp(data, response, predictors, folds: Folds | None = None, k: int = 5, levels=(0.5, 0.8, 0.95), **options):
    """Extras of a fold: basis, draws, mean CRPS and the share of observations inside the central intervals of ``levels``."""
    folds = folds or make_folds(data, k)

    def scores(fit, test):
        d = test.where(F.col(response).isNotNull()).join(fit.predict(test, draws=True).where("pred is not null"), "row_id")
        names = [f"coverage_{round(100 * level)}" for level in levels]
        row = d.agg(F.avg(crps_energy("draws", response)), *[F.avg(covered("draws", response, level)) for level in levels]).first()
        return {"gp_k": fit.info["k"], "gp_n_basis": fit.info["k"] ** 2, "n_draws": len(fit.info["draws"]), "CRPS": row[0]} | dict(zip(names, row[1:], strict=True))

    return cv_spatial(data, response, folds, lambda t: fit_gp(t, response, predictors, **options), scores)


def compare_models(fits: dict[str, SpatialFit], new: DataFrame | None = None, moran_k: int | None = None) -> list[dict]:
    """In-sample (or new-data) metrics by model, with AICc and fallback flags of local regressions and LOOIC of Gaussian processes; with ``moran_k`` also
    Moran's I of the residuals, its z and p, over so many neighbours."""
    moran = {} if moran_k is None else {r["model"]: r for r in residual_morans(fits, moran_k)}
    out = []
    for name, fit in fits.items():
        row = fit.metrics(new).first().asDict() | {"model": name, "engine": fit.engine}
        if fit.engine == "GWR":
            row |= {"AICc": fit.aicc(), "bandwidth_is_fallback": fit.info["fallback"]}
        if fit.engine == "GP":
            row |= {"LOOIC": fit.looic()}
        if name in moran:
            row |= {"moran_I": moran[name]["I"], "moran_z": moran[name]["z"], "moran_p": moran[name]["p"]}
        out.append(row)
    return out


def select_forward(data: DataFrame, response: str, candidates: list[str], folds: Folds, fit_fn=None, metric: str = "RMSE", tolerance: float = 0.0, max_vars: int | None = None, max_fits: int = 5000) -> tuple[list[str], float | None, list[dict]]:
    """(chosen, score, history) of greedy forward selection by cross-validated error.

    The first variable is always taken; later ones need a gain above the tolerance.  Rows must be
    complete in all candidates.  Without ``fit_fn`` linear models are scored by downdated sums.
    """
    p = len(candidates)
    if p * (p + 1) // 2 * max(1, folds.k) > max_fits:
        raise ValueError("the fit budget does not cover the search")
    clean = data.where(all_finite([response, *candidates])).persist()
    chosen, best, history = [], math.inf, []
    sign = -1 if metric == "R2" else 1
    while len(chosen) < (max_vars or p):
        step = []
        for c in (c for c in candidates if c not in chosen):
            v = [*chosen, c]
            preds = cv_ols(clean, response, v, folds) if fit_fn is None else cv_spatial(clean, response, folds, lambda t, v=v: fit_fn(t, v))[1]
            value = overall_metrics(preds).first()[metric]
            history.append({"step": len(chosen) + 1, "candidate": c, metric: value})
            if value is not None and np.isfinite(value):
                step.append((sign * value, len(step), c))
        if not step or (math.isfinite(best) and not best - min(step)[0] > tolerance):
            break
        best, _, c = min(step)
        chosen.append(c)
    return chosen, (sign * best if chosen else None), history


def compare_models_cv(data: DataFrame, response: str, predictors: list[str], models=("GWR", "GP"), folds: Folds | None = None, k: int = 5, options: dict | None = None) -> list[dict]:
    """Pooled out-of-fold metrics by model over the same folds; models: GWR, GP, RF."""
    run = {"GWR": cv_gwr, "GP": cv_gp, "RF": cv_forest}
    folds = folds or make_folds(data, k)
    chosen = [m for m in models if m in run] or ["GWR"]
    return [run[m](data, response, predictors, folds, **(options or {}).get(m, {}))[0].first().asDict() | {"model": m} for m in chosen]


def residual_morans(fits: dict[str, SpatialFit], k: int = 8) -> list[dict]:
    """Moran's I of each model's residuals, with its p-value."""
    from .autocorr import knn_weights, morans_i, p_value

    out = []
    for name, fit in fits.items():
        r = morans_i(fit.residuals(), knn_weights(fit.data, k)).first().asDict()
        out.append({"model": name, "p": p_value(r["z"])} | r)
    return out
