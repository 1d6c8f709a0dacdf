"""Registered queries do the whole job."""

import inspect
import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrastat.operators import models, tessellate
from terrastat.plans import registry

SF = "/root/testdata/sf0.001"


def test_voronoi_cells_of_all_customers(spark):
    rows = registry.voronoi_cells(spark, SF).collect()
    places = {(r.x, r.y): r.row_id for r in registry.customer_points(spark, SF).orderBy("row_id", ascending=False).collect()}
    assert sorted(r.cell_id for r in rows) == sorted(places.values())
    assert sum(r.area for r in rows) == pytest.approx(1000 * 1009, abs=1e-3)


def test_gp_basis_is_derived(spark, monkeypatch, caplog):
    """The reference's cap and iterations, and no basis size of the query's own."""
    given = {k: v.default for k, v in inspect.signature(models.fit_gp).parameters.items()}
    assert (given["max_basis"], given["iterations"], given["k"]) == (2500, 2000, None)
    p, seen = registry.embedding_points(spark, SF), []
    real = models.fit_gp
    monkeypatch.setattr(models, "fit_gp", lambda *a, **b: seen.append(b) or real(*a, max_basis=25, iterations=40, chains=2))
    with caplog.at_level(logging.WARNING):
        assert registry.gp_fitted(spark, SF).count() == p.count()
    assert seen == [{}] and "capped at 5 per axis" in caplog.text


def test_gp_cross_products_from_cosine_sums():
    rng = np.random.default_rng(3)
    f = pd.DataFrame(rng.normal(size=(200, 4)), columns=["x", "y", "w", "z"])
    info = {"mean": np.array([0.1, -0.2]), "sd": np.array([1.1, 0.9]), "L": np.array([9.0, 7.5]), "k": 6}
    d = np.column_stack([models._gp_design(f, ["w"], info), f["z"] - 0.3])
    sums = sum(models._gp_sums(f[a:b], ["w"], "z", 0.3, info) for a, b in ((0, 120), (120, 200)))
    assert np.allclose(models._gp_cross(sums, 2, info), d.T @ d, atol=1e-10)


def _linear(n, k=12):
    """A posterior of a response without noise, over ``n`` rows of a plan, with its triangle and cross-products."""
    rng = np.random.default_rng(4)
    f = pd.DataFrame(rng.normal(size=(min(n, 4000), 4)), columns=["x", "y", "w", "z"])
    f["z"] = f["x"] + 2 * f["y"] + 5 * f["w"]
    info = {"mean": np.zeros(2), "sd": np.ones(2), "L": np.array([9.0, 9.5]), "k": k}
    root = [np.arange(1, k + 1) * np.pi / (2 * v) for v in info["L"]]
    w2 = np.stack(np.meshgrid(root[0] ** 2, root[1] ** 2, indexing="ij"), -1).reshape(-1, 2)
    post = models._Posterior((0.4, 3.0), models.lengthscale_prior(0.4, 3.0), w2, 2, n, float(f["z"].var()), False, True)
    rows = np.column_stack([models._gp_design(f, ["w"], info)[:, post.order], f["z"]]) * np.sqrt(n / len(f))  # each row n / 4,000 times
    r = models._triangle(rows[at : at + 700] for at in range(0, len(f), 700))[:, np.append(post.place, 2 + k * k)]
    return post, r, r.T @ r


def test_gp_density_by_rotations_equals_that_by_cross_products():
    for n in (40, 4000):  # fewer rows than columns, too
        post, r, g = _linear(n)
        for t in (np.array([0.3, 0.5, 1.0, 1.0]), np.array([1.0, 0.8, 1.5, -4.0])):
            some, all_at_once = post.at(t, g, r), post.at(t, g)
            assert some[0] == pytest.approx(all_at_once[0], abs=1e-4) and set(some[4]) == set(all_at_once[4])
            told = some[3] * np.diag(g)[:-1] / post.sigma(t) ** 2
            assert 0 < (told > models.GRADED).sum() < len(some[4])  # some are taken first, others not
            assert np.allclose(post.coefficients(some), post.coefficients(all_at_once), atol=1e-4)
            upper = some[1]
            a = g[np.ix_(some[4], some[4])] / post.sigma(t) ** 2 + np.diag(1 / some[3][some[4]])
            assert np.allclose(upper.T @ upper, a, rtol=1e-9, atol=1e-9 * a.max()) and np.array_equal(upper, np.triu(upper))


def test_gp_density_of_many_rows_has_no_steps():
    """Ten million rows without noise: what rounding adds stays far below what tells hyper-parameters apart."""
    post, r, g = _linear(10_000_000)
    q = np.arange(30)
    v = np.array([post.at(np.array([1.0, 0.9, 1.6, -12.0 + 1e-6 * e]), g, r)[0] for e in q])
    assert np.std(v - np.polyval(np.polyfit(q, v, 2), q)) < 1e-7


def test_gp_chains_agree_on_a_large_layer_without_noise(spark):
    p = spark.range(100_000, numPartitions=3).select(F.col("id").alias("row_id"), *[F.randn(q).alias(c) for q, c in enumerate(("x", "y", "w1", "w2"))])
    fit = models.fit_gp(p.withColumn("z", F.expr("x + 2 * y + 5 * w1 + w2")), "z", ["w1", "w2"], k=16)
    assert max(fit.info["rhat"]) < 1.05
    assert fit.coef()["w1"][0] == pytest.approx(5, abs=1e-3) and fit.coef()["w2"][0] == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("n,least", [(500, 1), (500, 37), (9, 37)])
def test_triangle_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch, n, least):
    rows = np.random.default_rng(8).normal(size=(n, 5))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rows)], "row_id long, a double, b double, c double, d double, e double")
    real = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda d, parts, *keys: real(d, max(parts, least) if keys else parts, *keys))
    found = models._gp_triangle(df, lambda f: f[list("abcde")].to_numpy(), 5, n)
    got = found.toPandas().sort_values("i")
    r = np.stack(got["row"])
    assert r.shape == (5, 5) and np.array_equal(r, np.triu(r)) and np.allclose(r.T @ r, rows.T @ rows)


def test_mode_at_the_edge_of_the_support():
    t, cov = models._mode(lambda v: -float(v @ v) if v[0] < 1e-4 else -np.inf, np.array([0.0, 0.1]))
    assert np.isfinite(t).all() and np.isfinite(np.linalg.cholesky(cov)).all()


def test_forest_and_kmeans_run_in_full(spark, monkeypatch):
    """500 trees and 10 starts, the operators' defaults."""
    used = {}

    def noted(f):
        def run(*a, **b):
            given = inspect.signature(f).bind(*a, **b)
            given.apply_defaults()
            used.update(given.arguments)
            return a[0] if f is tessellate_kmeans else models.OLSFit("OLS", "z", [], a[0], {})

        return run

    tessellate_kmeans = tessellate.kmeans_seeds
    monkeypatch.setattr(models, "fit_forest", noted(models.fit_forest))
    monkeypatch.setattr(tessellate, "kmeans_seeds", noted(tessellate_kmeans))
    monkeypatch.setattr(models.OLSFit, "fitted", lambda self: self.data)
    registry.forest_oob(spark, SF)
    registry.kmeans_seeds(spark, SF)
    assert (used["trees"], used["starts"]) == (500, 10)
