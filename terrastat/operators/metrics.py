"""Regression metrics, probabilistic scores and ordinary least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, all_finite, quantile7


def regression_metrics(df: DataFrame, y="y", yhat="yhat", p: int | None = None, baseline=None) -> DataFrame:
    """One row: n, RMSE, MAE, MAPE, SMAPE, R2, Adj_R2 over rows with finite ``y`` and ``yhat``.

    ``baseline`` is the R2 reference: a column or number (training mean), the mean of ``y`` if None.
    """
    d = df.where(all_finite([y, yhat])).select(F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("f"), (F.col(baseline) if isinstance(baseline, str) else F.lit(baseline)).cast("double").alias("b"))
    if baseline is None:
        d = d.drop("b").crossJoin(F.broadcast(d.agg(F.avg("y").alias("b"))))  # one row: a scalar
    e, ay, den = F.col("y") - F.col("f"), F.abs("y"), F.abs("y") + F.abs("f")
    m = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.abs(e)).alias("MAE"),
        (100 * F.avg(F.when(ay > 100 * EPS, F.abs(e) / ay))).alias("MAPE"),
        (100 * F.avg(F.when(den > 100 * EPS, 2 * F.abs(e) / den))).alias("SMAPE"),
        F.sum(e * e).alias("rss"),
        F.sum((F.col("y") - F.col("b")) * (F.col("y") - F.col("b"))).alias("tss"),
    )
    r2 = F.when(F.col("tss") > EPS * F.col("n"), 1 - F.col("rss") / F.nullif("tss", F.lit(0.0)))
    m = m.withColumn("R2", r2)
    adj = F.when(F.col("n") > (p or 0) + 1, 1 - (1 - F.col("R2")) * (F.col("n") - 1) / F.nullif(F.col("n") - (p or 0) - 1, F.lit(0))) if p is not None else F.lit(None).cast("double")
    return m.withColumn("Adj_R2", adj).drop("rss", "tss")


def crps_energy(draws, y):
    """CRPS of an array of draws against an observation: mean |x - y| less half the mean draw spread; null without draws."""
    draws, y = F.col(draws) if isinstance(draws, str) else draws, F.col(y) if isinstance(y, str) else y
    m = F.nullif(F.size(draws), F.lit(0))
    ordered = F.array_sort(draws)
    first = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + F.abs(x - y)) / m
    ranked = F.zip_with(ordered, F.sequence(F.lit(1), m), lambda x, i: x * (2 * i - m - 1))
    return first - F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x) / (m * m)


def covered(draws, y, level: float):
    """1.0 where ``y`` lies in the central interval of the draws, type-7 quantiles; else 0.0."""
    ordered = F.array_sort(F.col(draws))
    return F.col(y).between(quantile7(ordered, (1 - level) / 2), quantile7(ordered, (1 + level) / 2)).cast("double")


def moments(df: DataFrame, response: str, predictors: list[str], by: list[str] | None = None) -> DataFrame:
    """Sufficient statistics of least squares: n, sums and cross-products, one row (per group)."""
    v = ["__1", *predictors, response]
    d = df.withColumn("__1", F.lit(1.0))
    aggs = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"s{i}_{j}") for i, a in enumerate(v) for j, b in enumerate(v) if i <= j]
    return (d.groupBy(*by) if by else d).agg(*aggs)


def solve_moments(row, p: int) -> np.ndarray | None:
    """Coefficients (intercept first) from a row of ``moments``; None where the design is singular."""
    m = np.zeros((p + 2, p + 2))
    for i in range(p + 2):
        for j in range(i, p + 2):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    xtx, xty = m[: p + 1, : p + 1], m[: p + 1, p + 1]
    if m[0, 0] < p + 1 or np.linalg.matrix_rank(xtx) < p + 1:
        return None
    return np.linalg.solve(xtx, xty)


def ols(df: DataFrame, response: str, predictors: list[str]) -> np.ndarray | None:
    """Least squares from one aggregate pass; columns are centred first, so sums don't cancel."""
    clean = df.where(all_finite([response, *predictors]))
    names = [response, *predictors]
    mean = clean.agg(*[F.avg(c).alias(c) for c in names]).first()
    if mean[0] is None:
        return None
    row = moments(clean.select(*[(F.col(c) - mean[c]).alias(c) for c in names]), response, predictors).first()
    beta = solve_moments(row, len(predictors))
    if beta is None:
        return None
    beta[0] += mean[response] - sum(b * mean[c] for b, c in zip(beta[1:], predictors, strict=True))
    return beta


def linear(beta, predictors):
    """The linear predictor as a column."""
    out = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], predictors, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out
