"""Plots, descriptions, the user's predicates, fold labels of the applicability index, quantiles over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.functions.exprs import point_in_edges
from terrastat.operators import aoa, folds, joins, models, surface, tessellate
from terrastat.operators.assign import assign_to_cells
from terrastat.operators.overlay import structs

BOX = "cell_id long, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"


def points(spark, xy, **columns):
    names = list(columns)
    rows = [(i, float(x), float(y), *[float(columns[c][i]) for c in names]) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, ", ".join(["row_id long", "x double", "y double", *[f"{c} double" for c in names]]))


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(3)
    xy, a = rng.random((90, 2)) * 100, rng.normal(size=90)
    return points(spark, xy, a=a, z=2 * a + 0.1 * rng.normal(size=90))


def test_quantiles(spark):
    v = np.random.default_rng(1).normal(size=501)
    p = points(spark, np.zeros((503, 2)), v=[*v, np.nan, 7.0]).withColumn("v", F.when(F.col("row_id") < 502, F.col("v")))
    at = [0.0, 0.1, 0.25, 0.333, 1.0]
    assert joins.quantiles(p.repartition(6), "v", at) == pytest.approx(np.quantile(v, at).tolist())
    assert joins.quantiles(p.where("row_id > 500"), "v", [0.5]) == [None] and joins.quantiles(p.where("row_id = 3"), "v", [0.2, 0.9]) == [v[3], v[3]]


def cells(spark):
    ring = lambda x: np.array([[x, 0], [x + 10, 0], [x + 10, 10], [x, 10]], float)
    return spark.createDataFrame([(i + 1, structs([ring(x)]), x, 0.0, x + 10, 10.0) for i, x in enumerate((0.0, 20.0))], BOX)


def test_predicates_and_fallback(spark):
    p = points(spark, [(5, 5), (0.5, 5), (14, 5), (16, 5), (15, 5), (25, 9.5)])
    deep = lambda x, y, e: point_in_edges(x, y, e) & F.forall(e, lambda s: joins.edge_distance2(x, y, s) >= 1)
    assert [(r.row_id, r.cell_id) for r in joins.polygon_matches(p, cells(spark), predicate=deep).collect()] == [(0, 1)]
    around = lambda x, y, e: F.exists(e, lambda s: joins.edge_distance2(x, y, s) <= 16)
    assert sorted((r.row_id, r.cell_id) for r in joins.polygon_matches(p, cells(spark), predicate=around, distance=4).collect()) == [(1, 1), (2, 1), (3, 2), (5, 2)]
    got = {r.row_id: r.cell_id for r in assign_to_cells(p, cells(spark), fallback="centroid").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 2}  # a tie goes to the lower id
    with pytest.raises(ValueError):
        assign_to_cells(p, cells(spark), fallback="other")


def test_fold_labels_of_the_index(spark, layer):
    good = layer.select("row_id", (F.col("row_id") % 3).alias("fold"))
    new, di, top = aoa.area_of_applicability(layer.limit(5), layer, ["a", "z"], folds=good)
    text = aoa.describe(new, di, top)
    assert "new rows: 5 (0 without" in text and "training rows: 90" in text
    assert aoa.area_of_applicability(layer.limit(5), layer, ["a", "z"], folds=folds.random_folds(layer, 3))[1].count() == 90
    wrong = {
        "missing labels": good.withColumn("fold", F.when(F.col("row_id") > 3, F.col("fold"))),
        "two non-empty": good.withColumn("fold", F.lit(1)),
        "more than one fold": good.unionByName(good.where("row_id = 2").withColumn("fold", F.lit(7).cast("long"))),
        "do not have": good.unionByName(spark.createDataFrame([(999, 1)], "row_id long, fold long")),
        "in no fold": good.where("row_id <> 4"),
        "excluded": folds.buffered_loo(layer, 5.0),
    }
    for message, labels in wrong.items():
        with pytest.raises(ValueError, match=message):
            aoa.checked_folds(labels, layer)


def test_plots_count_all_rows(spark, layer):
    f = folds.random_folds(layer, 4)
    svg = surface.plot_folds(f, layer, columns=400)
    assert svg.count("<circle") == 90 and "random_kfold, 4 folds" in svg and surface.PALETTE[3] in svg
    assert surface.plot_folds(f, layer, columns=1).count("<circle") == 1
    fit = models.fit_ols(layer, "z", ["a"])
    assert "<line" in surface.plot_fit(fit) and surface.plot_fit(fit, "residuals", columns=300).count("<circle") == 90
    assert surface.plot_folds(f, layer.limit(0)).startswith("<svg")
    with pytest.raises(ValueError):
        surface.plot_fit(fit, "other")


def test_descriptions(spark, layer):
    fit = models.fit_forest(layer, "z", ["a", "x"], trees=40)
    text = str(fit)
    assert "out of bag" in text and text.index("  a:") < text.index("  x:")
    assert models.model_available("gwr") and not models.model_available("kriging")


def test_grids_are_kept_by_boundary(spark):
    tessellate.clear_grid_cache()
    box, edge = (0.0, 10.0, 0.0, 10.0), [np.array([[0, 0], [10, 0], [0, 10]], float)]
    whole, part = tessellate.cached_grid(spark, box, 16), tessellate.cached_grid(spark, box, 16, boundary=edge)
    assert whole is not part and part.count() < whole.count() and tessellate.cached_grid(spark, box, 16, boundary=edge) is part
    assert tessellate.cached_grid(spark, box, 16, crs="other") is not whole and tessellate.clear_grid_cache() == 3


def test_spherical_fallback(spark, monkeypatch):
    from terrastat.operators import autocorr

    rng = np.random.default_rng(2)
    p = points(spark, rng.random((60, 2)) * 100, z=rng.normal(size=60))
    real = autocorr.fit_variogram
    monkeypatch.setattr(autocorr, "fit_variogram", lambda rows, model="Exp": None if model == "Exp" else real(rows, model) and {"model": "Sph", "nugget": 0.0, "psill": 1.0, "range": 12.0, "sse": 0.0})
    r = autocorr.sac_range(p, "z")
    assert r.model["model"] == "Sph" and r.value == 12.0


def test_forest_options(spark, layer, monkeypatch, caplog):
    import logging

    base = models.fit_forest(layer, "z", ["a"], trees=30, importance="impurity")
    assert set(base.info["importance"]) == {"a"} and base.info["importance"]["a"] > 0
    with caplog.at_level(logging.WARNING):
        placed = models.fit_forest(layer, "z", ["a"], trees=30, importance="none", include_coords=True)
        models.fit_forest(layer.withColumn("z", (F.col("z") > 0).cast("int")), "z", ["a"], trees=3)
    assert "importance" not in placed.info and placed.info["columns"] == ["a", "x", "y"] and "coordinates are predictors" in caplog.text and "estimates a share" in caplog.text
    sent = {r.row_id: r.pred for r in placed.predict(layer).collect()}
    placed.info["sent"] = None
    monkeypatch.setattr(models, "FOREST_GROUP", 5000)
    grouped = {r.row_id: r.pred for r in placed.predict(layer).collect()}
    assert grouped.keys() == sent.keys() and all(grouped[k] == pytest.approx(sent[k]) for k in sent)
    for wrong in ({"importance": "gain"}, {"response": "name"}):
        with pytest.raises(ValueError):
            models.fit_forest(layer.withColumn("name", F.lit("s")), wrong.get("response", "z"), ["a"], trees=2, importance=wrong.get("importance", "none"))
    with pytest.raises(ValueError):
        models.fit_forest(layer.limit(1), "z", ["a"])


def test_predictions_in_another_system(spark):
    """Rows in degrees get what they get in the fit's own projection."""
    from terrastat.sources.crs import LONGLAT, reproject, utm

    rng = np.random.default_rng(6)
    a = rng.normal(size=60)
    degrees = points(spark, np.column_stack([-78.9 + rng.random(60) / 2, 35.5 + rng.random(60) / 2]), a=a)
    own = reproject(degrees, LONGLAT, utm(17))
    data = own.withColumn("z", F.col("a") * (F.col("x") - 3e5) / 1e5).persist()
    fit = models.fit_gwr(data, "z", ["a"], 20)
    with pytest.raises(ValueError):
        fit.predict_in(degrees, LONGLAT)
    fit.info["crs"] = utm(17)
    want = {r.row_id: r.pred for r in fit.predict(own).collect()}
    got = {r.row_id: r.pred for r in fit.predict_in(degrees, LONGLAT).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want) and {r.row_id: r.pred for r in fit.predict_in(own, utm(17)).collect()} == want


def test_criteria_of_levels(spark, layer, caplog):
    import logging

    some = layer.withColumn("z", F.col("x") / 10 + F.col("a"))
    best, table = tessellate.optimal_levels(some, max_levels=9, response="z", criterion="morans_i")
    known = {r["k"]: r["moran"] for r in table if r.get("moran") is not None}
    assert best[0] == min(known, key=lambda k: (known[k], k)) and len(best) <= 3
    assert tessellate.optimal_levels(some, max_levels=6, response="z", criterion="geometric")[0] == tessellate.optimal_levels(some, max_levels=6)[0]
    with caplog.at_level(logging.WARNING):
        tessellate.optimal_levels(some, max_levels=4, criterion="combined")
    assert "needs a response" in caplog.text
    with pytest.raises(ValueError):
        tessellate.optimal_levels(some, criterion="other")
