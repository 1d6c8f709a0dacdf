"""Posterior tools: length-scale priors, Pareto-smoothed leave-one-out, response families."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD_K = 0.7  # above it an importance-sampled leave-one-out term is not reliable


# length scales -----------------------------------------------------------------------------------


def gamma_below(a: float, x: float) -> float:
    """P(G < x) of a gamma variable with shape ``a`` and rate 1: a power series below the mean, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    # the fraction's value from its end: x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / ...), by the modified rule for ratios
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def gamma_quantile(a: float, p: float) -> float:
    lo, hi = 0.0, max(1.0, 2 * a)
    while gamma_below(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if gamma_below(a, mid) < p else (lo, mid)
    return (lo + hi) / 2


class InverseGamma(NamedTuple):
    shape: float
    scale: float
    ok: bool

    def below(self, x: float) -> float:
        return 1 - gamma_below(self.shape, self.scale / x)

    def log_density(self, x: float) -> float:
        return self.shape * math.log(self.scale) - math.lgamma(self.shape) - (self.shape + 1) * math.log(x) - self.scale / x


def lengthscale_prior(lower: float, upper: float, tail: float = 0.01) -> InverseGamma:
    """The inverse gamma with ``tail`` of its mass below ``lower`` and as much above ``upper``.

    The ratio of its two quantiles falls with the shape alone, so the shape is found by bisection and the scale follows.
    ``ok`` is false, and the other figures are not numbers, where the bounds are no proper interval or no shape reaches
    the tails; callers fall back to a half-normal then.
    """
    bad = InverseGamma(math.nan, math.nan, False)
    if not (math.isfinite(lower or math.nan) and math.isfinite(upper or math.nan)) or lower <= 0 or upper <= lower or not 0 < tail < 0.5:
        return bad
    ratio = lambda a: gamma_quantile(a, 1 - tail) / max(gamma_quantile(a, tail), 1e-300)
    lo, hi, want = math.log(0.05), math.log(20_000.0), upper / lower
    if not ratio(math.exp(hi)) < want < ratio(math.exp(lo)):
        return bad
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ratio(math.exp(mid)) > want else (lo, mid)
    shape = math.exp((lo + hi) / 2)
    prior = InverseGamma(shape, lower * gamma_quantile(shape, 1 - tail), True)
    ok = abs(prior.below(lower) - tail) < tail / 2 and abs(1 - prior.below(upper) - tail) < tail / 2
    return prior if ok else bad


# leave-one-out -----------------------------------------------------------------------------------


def pareto_fit(excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, sigma) of generalised Pareto tails, a row of ascending excesses each.

    The profile likelihood of b = -k / sigma is averaged over a grid whose points are spread by the sample's quartile;
    k is drawn towards 0.5 with the weight of ten observations.
    """
    rows, n = excess.shape
    m = 30 + math.isqrt(n)
    quartile = excess[:, int(n / 4 + 0.5) - 1]
    spread = 1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    b = 1 / excess[:, -1:] + spread / (3 * quartile[:, None])
    # mean over observations of log(1 - b x): grid points one by one, so that memory is rows x grid
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.stack([np.log1p(-b[:, [j]] * excess).mean(1) for j in range(m)], 1)
        like = n * (np.log(-b / k) - k - 1)
        like = np.where(np.isfinite(like), like, -np.inf)
    weight = np.exp(like - like.max(1, keepdims=True))
    best = (b * weight).sum(1) / weight.sum(1)
    k = np.log1p(-best[:, None] * excess).mean(1)
    return (k * n + 5) / (n + 10), -k / best


def smoothed(log_ratios: np.ndarray, r_eff: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(log weights, k-hat) by row: the largest importance ratios are replaced by the quantiles of a Pareto tail."""
    lw = log_ratios - log_ratios.max(1, keepdims=True)
    draws = lw.shape[1]
    tail = min(math.ceil(0.2 * draws), math.ceil(3 * math.sqrt(draws / r_eff)))
    k = np.full(len(lw), np.inf)
    if tail < 5 or draws <= tail:
        return lw, k
    order = np.argsort(lw, 1, kind="stable")
    at = order[:, -tail:]
    cut = np.maximum(np.take_along_axis(lw, order[:, [-tail - 1]], 1), math.log(np.finfo(float).tiny))
    top = np.take_along_axis(lw, at, 1)
    excess = np.exp(top) - np.exp(cut)
    varied = top[:, -1] - top[:, 0] > np.finfo(float).eps * 100
    if varied.any():
        fit = np.maximum(excess[varied], 1e-300)
        k[varied], sigma = pareto_fit(fit)
        p = (np.arange(1, tail + 1) - 0.5) / tail
        kk = k[varied][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.where(np.abs(kk) > 1e-12, sigma[:, None] * np.expm1(-kk * np.log1p(-p)) / kk, -sigma[:, None] * np.log1p(-p))
        new = np.where(np.isfinite(kk), np.log(q + np.exp(cut[varied])), top[varied])
        lw[varied] = _put(lw[varied], at[varied], np.minimum(new, 0.0))
    k[~varied] = -np.inf if draws > 1 else np.inf  # a tail of equal weights needs no smoothing
    return lw, k


def _put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    np.put_along_axis(rows, at, values, 1)
    return rows


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


LOO = "row_id long, elpd double, p_loo double, k_hat double"


def psis_loo(log_lik: DataFrame, r_eff: float = 1.0) -> DataFrame:
    """``row_id, elpd, p_loo, k_hat`` of rows (``row_id, log_lik`` array by draw): the expected log density of each row when
    it is left out, from Pareto-smoothed importance weights, and the effective parameters it costs.

    Rows are independent, so the work is a map over batches.  A row with a missing or infinite draw gets nulls; rows with
    equal draws have nothing to smooth and a k-hat of minus infinity.
    """

    def run(frames):
        for whole in frames:
            for at in range(0, len(whole), 1000):  # a row is as many numbers as draws
                f = whole[at : at + 1000]
                lik = [np.asarray(v, float) if v is not None else np.array([math.nan]) for v in f["log_lik"]]
                out = np.full((len(f), 3), math.nan)
                good = np.array([bool(len(v)) and bool(np.isfinite(v).all()) for v in lik], bool)
                sizes = {len(v) for v, g in zip(lik, good, strict=True) if g}
                for n in sizes:
                    rows = np.flatnonzero([g and len(v) == n for v, g in zip(lik, good, strict=True)])
                    for b in range(0, len(rows), 512):
                        r = rows[b : b + 512]
                        ll = np.stack([lik[i] for i in r])
                        lw, k = smoothed(-ll, r_eff)
                        elpd = _log_sum(lw + ll) - _log_sum(lw)
                        out[r] = np.column_stack([elpd, _log_sum(ll) - math.log(n) - elpd, k])
                yield pd.DataFrame({"row_id": f["row_id"], "elpd": pd.array(out[:, 0]), "p_loo": pd.array(out[:, 1]), "k_hat": pd.array(out[:, 2])})

    found = log_lik.select("row_id", "log_lik").mapInPandas(run, LOO)
    return found.select("row_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("elpd", "p_loo", "k_hat")])


def loo_summary(loo: DataFrame, good_k: float = GOOD_K) -> DataFrame:
    """One row: ``n, elpd, se, p_loo, looic, high_k`` (rows whose k-hat is above ``good_k``), over rows with a value."""
    known = loo.where("elpd is not null")
    n = F.count(F.lit(1))
    return known.agg(
        n.alias("n"),
        F.sum("elpd").alias("elpd"),
        F.sqrt(n * F.var_samp("elpd")).alias("se"),
        F.sum("p_loo").alias("p_loo"),
        (-2 * F.sum("elpd")).alias("looic"),
        F.sum((F.col("k_hat") > good_k).cast("long")).alias("high_k"),
    )


# response families -------------------------------------------------------------------------------

FAMILIES = ("gaussian", "binomial", "poisson")


def mean_of(family: str, eta: np.ndarray) -> np.ndarray:
    if family == "binomial":
        return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    return np.exp(np.clip(eta, -700, 30)) if family == "poisson" else eta


def working(family: str, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, working response) of a Fisher-scoring step."""
    mu = mean_of(family, eta)
    w = np.maximum(mu * (1 - mu) if family == "binomial" else mu, 1e-9)
    return w, eta + (y - mu) / w


def log_likelihood(family: str, y: np.ndarray, eta: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Of observations (rows) under draws (columns)."""
    y = y[:, None]
    if family == "binomial":
        return y * eta - np.logaddexp(0, eta)
    if family == "poisson":
        return y * eta - np.exp(np.clip(eta, -700, 30)) - np.array([math.lgamma(v + 1) for v in y[:, 0]])[:, None]
    return -0.5 * ((y - eta) / sigma) ** 2 - np.log(sigma) - 0.5 * math.log(2 * math.pi)


def _uniform(rows: np.ndarray, draws: int, stream: int) -> np.ndarray:
    """Numbers in (0, 1) by row id, draw and stream: the same however rows are dealt out."""
    with np.errstate(over="ignore"):
        h = rows.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(draws, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(stream + 1) * np.uint64(0x94D049BB133111EB)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def simulated(family: str, rows: np.ndarray, eta: np.ndarray, sigma: np.ndarray, seed: int) -> np.ndarray:
    """Draws of new observations."""
    u = _uniform(rows, eta.shape[1], 2 * seed)
    if family == "gaussian":
        return eta + sigma * np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * _uniform(rows, eta.shape[1], 2 * seed + 1))
    mu = mean_of(family, eta)
    if family == "binomial":
        return (u < mu).astype(float)
    count, p = np.zeros_like(mu), np.exp(-mu)  # by inversion, up to where the double's tail ends
    total = p.copy()
    for _ in range(int(np.max(mu, initial=0) + 12 * math.sqrt(np.max(mu, initial=0)) + 30)):
        more = u > total
        if not more.any():
            break
        count += more
        p = p * mu / np.maximum(count, 1)
        total = np.where(more, total + p, total)
    return count
