"""Length-scale priors, Pareto-smoothed leave-one-out, response families of the Gaussian process."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.operators import bayes, cv, models


def points(spark, xy, **columns):
    names = list(columns)
    rows = [(i, float(x), float(y), *[float(columns[c][i]) for c in names]) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, ", ".join(["row_id long", "x double", "y double", *[f"{c} double" for c in names]]))


def test_incomplete_gamma():
    for x in (0.1, 1.0, 3.0, 20.0):
        assert bayes.gamma_below(1.0, x) == pytest.approx(1 - math.exp(-x), abs=1e-13)
        assert bayes.gamma_below(2.0, x) == pytest.approx(1 - math.exp(-x) * (1 + x), abs=1e-13)
        assert bayes.gamma_below(0.5, x) == pytest.approx(math.erf(math.sqrt(x)), abs=1e-13)
    assert bayes.gamma_below(300.0, bayes.gamma_quantile(300.0, 0.2)) == pytest.approx(0.2, abs=1e-10)


@pytest.mark.parametrize("lower,upper", [(0.4654, 1.8450), (0.4657, 1.9560), (0.4549, 1.93), (0.2, 1.4), (3.0, 900.0)])
def test_prior_has_both_tails(lower, upper):
    prior = bayes.lengthscale_prior(lower, upper)
    assert prior.ok and prior.below(lower) == pytest.approx(0.01, abs=1e-6) and 1 - prior.below(upper) == pytest.approx(0.01, abs=1e-6)
    assert prior.below(lower) < 0.5 < prior.below(upper)
    x = np.linspace(lower / 4, upper * 6, 400_001)
    assert np.trapezoid([math.exp(prior.log_density(v)) for v in x[::40]], x[::40]) == pytest.approx(1, abs=2e-3)


def test_prior_declines():
    for bounds in ((1, 1), (2, 1), (-1, 5), (0, 5), (math.nan, 5), (0.1, math.inf), (1.0, 1.0001)):
        assert not bayes.lengthscale_prior(*bounds).ok
    loose, tight = bayes.lengthscale_prior(0.4, 2.0, 0.05), bayes.lengthscale_prior(0.4, 2.0, 0.001)
    assert tight.below(0.4) < loose.below(0.4)


@pytest.mark.parametrize("k", [-0.2, 0.0, 0.4, 0.9])
def test_pareto_fit_finds_its_tail(k):
    u = np.random.default_rng(3).random((40, 4000))
    x = np.sort(2 * (np.expm1(-k * np.log(u)) / k if k else -np.log(u)), 1)
    found, sigma = bayes.pareto_fit(x)
    assert found.mean() == pytest.approx(k, abs=0.03) and sigma.mean() == pytest.approx(2, rel=0.03)


def linear_case(n=60, s=0.7, draws=4000, outlier=False):
    """Draws of a linear model with known noise and a flat prior, and its exact leave-one-out terms."""
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
    y = x @ [1.0, 2.0, -1.0] + s * rng.normal(size=n)
    if outlier:
        x[0], y[0] = [1.0, 5.0, 5.0], 11.0
    v = np.linalg.inv(x.T @ x) * s * s
    beta = rng.multivariate_normal(v @ x.T @ y / s**2, v, draws)
    lik = -0.5 * ((y[:, None] - x @ beta.T) / s) ** 2 - math.log(s * math.sqrt(2 * math.pi))
    exact = []
    for i in range(n):
        keep = np.arange(n) != i
        w = np.linalg.inv(x[keep].T @ x[keep]) * s * s
        var = s * s + x[i] @ w @ x[i]
        exact.append(-0.5 * (y[i] - x[i] @ (w @ x[keep].T @ y[keep]) / s**2) ** 2 / var - 0.5 * math.log(2 * math.pi * var))
    return lik, np.array(exact)


def test_loo_is_exact_leave_one_out(spark):
    lik, exact = linear_case()
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(lik)], "row_id long, log_lik array<double>")
    got = {r.row_id: r for r in bayes.psis_loo(df.repartition(5)).collect()}
    assert max(abs(got[i].elpd - e) for i, e in enumerate(exact)) < 0.02 and max(r.k_hat for r in got.values()) < 0.5
    total = bayes.loo_summary(bayes.psis_loo(df)).first()
    assert total["n"] == 60 and total["elpd"] == pytest.approx(exact.sum(), abs=0.05) and total["looic"] == pytest.approx(-2 * total["elpd"])
    assert total["p_loo"] == pytest.approx(3, abs=1.2) and total["high_k"] == 0
    lik, _ = linear_case(outlier=True)
    marked = {r.row_id: r.k_hat for r in bayes.psis_loo(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(lik)], df.schema)).collect()}
    assert marked[0] > 0.7 > max(v for k, v in marked.items() if k)  # far out, and pulls the fit


def test_loo_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [math.nan] * 50), (4, [-1.5] * 50), (5, [-2.0, -3.0]), (6, [float(-(i % 7)) for i in range(40)]), (7, [-math.inf] + [-1.0] * 49)]
    got = {r.row_id: r for r in bayes.psis_loo(spark.createDataFrame(rows, "row_id long, log_lik array<double>")).collect()}
    assert len(got) == 7 and all(got[i].elpd is None and got[i].k_hat is None for i in (1, 2, 3, 7))
    assert got[4].elpd == pytest.approx(-1.5) and got[4].p_loo == pytest.approx(0, abs=1e-12) and got[5].elpd is not None and got[6].elpd is not None
    assert bayes.loo_summary(bayes.psis_loo(spark.createDataFrame(rows[:3], "row_id long, log_lik array<double>"))).first()["n"] == 0


def test_draws_of_new_observations_do_not_depend_on_partitions():
    rows, eta = np.arange(50), np.random.default_rng(2).normal(size=(50, 4000))
    for family, mean in (("gaussian", eta), ("binomial", 1 / (1 + np.exp(-eta))), ("poisson", np.exp(eta))):
        out = bayes.simulated(family, rows, eta, np.full(4000, 0.5), 3)
        assert np.array_equal(out[20:30], bayes.simulated(family, rows[20:30], eta[20:30], np.full(4000, 0.5), 3))
        assert out.mean() == pytest.approx(mean.mean(), abs=0.02)


@pytest.fixture(scope="module")
def gaussian(spark):
    rng = np.random.default_rng(6)
    xy, a = rng.random((150, 2)) * 100, rng.normal(size=150)
    z = np.sin(xy[:, 0] / 20) + 0.5 * a + 0.1 * rng.normal(size=150)
    p = points(spark, xy, a=a * 7 + 3, z=z)
    return p, models.fit_gp(p, "z", ["a"], k=10, chains=4, iterations=1500, standardize_predictors=True)


def test_gaussian_fit_and_its_draws(spark, gaussian):
    p, fit = gaussian
    assert max(fit.info["rhat"]) < 1.05 and fit.info["prior"].ok and fit.metrics().first()["R2"] > 0.95
    assert fit.coef()["a"][0] == pytest.approx(0.5, abs=0.05)  # of the standardised predictor
    median = {r.row_id: r.pred for r in fit.predict(p, summary="median").collect()}
    mean = {r.row_id: r.pred for r in fit.predict(p).collect()}
    assert max(abs(median[i] - mean[i]) for i in mean) < 0.05
    epred = fit.predict(p, draws=True).join(p, "row_id").select(F.avg(F.element_at(F.array_sort("draws"), -1) - F.array_min("draws"))).first()[0]
    new = fit.predict(p.repartition(3), draws=True, type="predict").join(p, "row_id").select("z", F.array_sort("draws").alias("d")).collect()
    inside = np.mean([r.d[int(0.05 * len(r.d))] <= r.z <= r.d[int(0.95 * len(r.d)) - 1] for r in new])
    assert 0.8 < inside <= 1 and np.mean([r.d[-1] - r.d[0] for r in new]) > epred
    table = fit.summary()
    assert table["table"]["sigma"]["mean"] == pytest.approx(0.1, abs=0.03) and set(table["rhat"]) == {"lscale_x", "lscale_y", "sdgp", "sigma"}
    with pytest.raises(ValueError):
        fit.predict(p, summary="mode")


def test_looic_of_models(spark, gaussian):
    p, fit = gaussian
    rows = {r["model"]: r for r in cv.compare_models({"GP": fit, "OLS": models.fit_ols(p, "z", ["a"])})}
    total = bayes.loo_summary(fit.loo()).first()
    assert rows["GP"]["LOOIC"] == pytest.approx(total["looic"]) and "LOOIC" not in rows["OLS"] and total["high_k"] < 8
    folds = [r.row_id for r in p.select("row_id").limit(12).collect()]
    brute = []
    for i in folds[:3]:  # refits without the row
        part = models.fit_gp(p.where(F.col("row_id") != i), "z", ["a"], k=10, chains=2, iterations=300, standardize_predictors=True)
        lik = np.array(part.log_lik(p.where(F.col("row_id") == i)).first()["log_lik"])
        brute.append(np.log(np.mean(np.exp(lik))))
    loo = {r.row_id: r.elpd for r in fit.loo().collect()}
    assert [loo[i] for i in folds[:3]] == pytest.approx(brute, abs=0.25)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_families_are_calibrated(spark, family):
    rng = np.random.default_rng(12)
    n = 1500
    xy, a = rng.random((n, 2)) * 100, rng.normal(size=n)
    eta = 1.2 * np.sin(xy[:, 0] / 15) + 0.8 * a - 0.3
    mu = bayes.mean_of(family, eta)
    y = (rng.random(n) < mu).astype(float) if family == "binomial" else rng.poisson(mu).astype(float)
    p = points(spark, xy, a=a, z=y)
    fit = models.fit_gp(p, "z", ["a"], k=8, chains=4, iterations=1000, family=family, iso=True)
    got = np.array([r.pred for r in fit.fitted().orderBy("row_id").collect()])
    assert max(fit.info["rhat"]) < 1.05 and fit.coef()["a"][0] == pytest.approx(0.8, abs=0.2) and fit.info["hyper"] == ["lscale", "sdgp"]
    assert np.corrcoef(got, mu)[0, 1] > 0.9
    for part in np.array_split(np.argsort(got), 5):  # mean predicted and observed by fifths
        assert got[part].mean() == pytest.approx(y[part].mean(), rel=0.2, abs=0.06)
    assert math.isfinite(fit.looic())


def test_families_refuse_other_responses(spark):
    p = points(spark, np.random.default_rng(1).random((20, 2)), z=np.linspace(0, 3, 20))
    for family in ("binomial", "poisson", "gamma"):
        with pytest.raises(ValueError):
            models.fit_gp(p, "z", [], family=family)
