"""Hand-checked values, identities and two-path equivalences of the spatial operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.functions.exprs import is_finite, quantile7, shoelace
from terrastat.operators import aoa, assign, autocorr, cv, folds, metrics, models, surface, tessellate
from terrastat.operators.joins import distance_join, knn_join, nearest_polygon, polygon_matches
from terrastat.plans.layers import literal_cells
from terrastat.sources.crs import LONGLAT, NONE, ensure_projected, harmonize, pick_local
from terrastat.sources.layer import Layer, dedup_points, prediction_grid, prep_model_data


def points(spark, xy, **cols):
    names = list(cols)
    rows = [(i + 1, float(x), float(y), *[cols[c][i] for c in names]) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "row_id long, x double, y double" + "".join(f", {c} double" for c in names))


def cloud(n, seed=3, scale=100.0):
    return np.random.default_rng(seed).random((n, 2)) * scale


def test_finite(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in d.select(is_finite("v")).collect()] == [True, False, False, False]


def test_quantile7(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0],)], "a array<double>")
    assert d.select(quantile7("a", 0.75)).first()[0] == 3.0


def test_crs_choice():
    assert pick_local(-78.9, -78.3, 35.5, 36.1).epsg == 32617
    assert pick_local(-100, -95.5, 38, 42).kind == "utm"
    assert pick_local(-100, -92, 38, 42).kind == "albers"
    assert pick_local(-100, -60, -10, 10).kind == "laea"
    assert harmonize(NONE, LONGLAT) == LONGLAT


def test_unlabelled_integers_are_left_alone(spark):
    p = points(spark, [(1, 1), (1, 2)])
    assert ensure_projected(p, NONE)[1].kind == "none"
    assert ensure_projected(points(spark, [(1.5, 1.2), (1.7, 1.9)]), NONE)[1].kind == "utm"


def test_knn_matches_brute_force(spark):
    xy = np.vstack([cloud(120), cloud(5, 9, 5000.0)])
    got = {(r.i, r["rank"]): r.j for r in knn_join(points(spark, xy), points(spark, xy), 4, exclude_self=True).collect()}
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i][:4]
        assert [got[(i + 1, k + 1)] for k in range(4)] == [j + 1 for j in order]


def test_distance_join(spark):
    xy = cloud(80)
    got = {(r.i, r.j) for r in distance_join(points(spark, xy), points(spark, xy), 12.0).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    assert got == {(i + 1, j + 1) for i, j in zip(*np.where(d <= 12.0), strict=True)}


def test_edges_and_ties(spark):
    p = points(spark, [(400, 100), (200, 200), (700, 500), (5000, 5000)])
    got = {r.row_id: r.cell_id for r in assign.assign_to_cells(p, literal_cells(spark), keep_unassigned=True).collect()}
    assert got == {1: 1, 2: 3, 3: 5, 4: None}
    assert {r.row_id: r.cell_id for r in assign.point_cell_index(p, literal_cells(spark)).collect()} == {1: 1, 2: 1, 3: 2, 4: 4}
    assert polygon_matches(p, literal_cells(spark), predicate="within").where("row_id = 1").count() == 0
    assert nearest_polygon(p.where("row_id = 4"), literal_cells(spark)).count() == 1


def test_hole_is_outside(spark):
    ring = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    c = spark.createDataFrame([(1, [ring(0.0, 10.0), ring(4.0, 6.0)], 0.0, 0.0, 10.0, 10.0)], tessellate.CELL)
    assert [r.row_id for r in polygon_matches(points(spark, [(5, 5), (1, 1)]), c).collect()] == [2]


def test_design_effect_identities(spark):
    p = points(spark, cloud(10), cell_id=[1.0] * 10)
    flat = [{"model": "Nug", "psill": 0.6, "range": 0}, {"model": "Exp", "psill": 0.4, "range": 1e15}]
    assert assign.cell_design_effect(p, flat).first()["deff"] == pytest.approx(4.6)
    h0 = spark.range(1).select(assign.variogram_correlation(F.lit(0.0), [{"model": "Nug", "psill": 0.2, "range": 0}, {"model": "Exp", "psill": 0.8, "range": 5}])).first()[0]
    assert h0 == pytest.approx(0.8)


def test_fixed_effect_scales_errors(spark):
    p = points(spark, cloud(20), cell_id=[float(i % 4) for i in range(20)], v=[float(i) for i in range(20)])
    one = {r.cell_id: r.se_resp_v for r in assign.summarize_by_cell(p, "v").collect()}
    two = {r.cell_id: r.se_resp_v for r in assign.summarize_by_cell(p, "v", deff=2).collect()}
    assert all(two[k] == pytest.approx(one[k] * math.sqrt(2)) for k in one)
    assert assign.summarize_by_cell(p, "v", deff="kish").count() == 4


def test_voronoi_partitions_the_box(spark):
    xy = cloud(60)
    box = np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)
    cells = tessellate.voronoi_cells(points(spark, xy), box)
    assert cells.agg(F.sum(F.abs(shoelace("rings")))).first()[0] == pytest.approx(10_000)


def test_delaunay_covers_the_hull():
    xy = cloud(40)
    tri, hull = tessellate.delaunay(xy), tessellate.convex_hull(xy)
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, np.roll(r, -1, 0), strict=True))) / 2
    assert sum(area(xy[t]) for t in tri) == pytest.approx(area(hull), rel=1e-6)


def test_hexagons(spark):
    n = tessellate.grid_size(100, 100, 400, "hex")
    assert 200 < n[0] * n[1] < 500
    box = (0.0, 100.0, 0.0, 100.0)
    p = points(spark, cloud(200))
    by_arith = {r.row_id: r.c for r in p.select("row_id", tessellate.hex_cell_of(F.col("x"), F.col("y"), box, 13.0).alias("c")).collect()}
    by_join = {r.row_id: r.cell_id for r in polygon_matches(p, tessellate.hex_grid(spark, box, 13.0)).groupBy("row_id").agg(F.min("cell_id").alias("cell_id")).collect()}
    assert by_arith == by_join


def test_grid_cache(spark):
    a = tessellate.cached_grid(spark, (0.0, 10.0, 0.0, 10.0), 9)
    assert tessellate.cached_grid(spark, (0.0, 10.0, 0.0, 10.0), 9) is a and a.count() == 9
    assert tessellate.clear_grid_cache() == 1


def test_elbow():
    assert tessellate.elbow([100, 40, 10, 8, 7])[0] == 3
    assert tessellate.elbow([5, 5, 5])[0] == 2


def test_fold_partitions(spark):
    p = points(spark, cloud(53), g=[float(i % 6) for i in range(53)])
    for f in (folds.random_folds(p, 5), folds.block_folds(p, 4), folds.location_folds(p, "g", 3)):
        assert f.assignment.count() == 53 and f.assignment.select("row_id").distinct().count() == 53
    sizes = sorted(r["count"] for r in folds.random_folds(p, 5).assignment.groupBy("fold").count().collect())
    assert sizes == [10, 10, 11, 11, 11]
    with pytest.raises(ValueError):
        folds.random_folds(p, 1)
    with pytest.raises(ValueError):
        folds.make_folds(p, 3, "other")


def test_buffered_and_matched_folds(spark):
    p = points(spark, [(0, 0), (3, 0), (14, 0), (1000, 0), (1016, 0), (1032, 0)])
    f = folds.buffered_loo(p, 11.0)
    assert [r.row_id for r in f.train(1, p).orderBy("row_id").collect()] == [3, 4, 5, 6]
    m = folds.nndm_folds(p, points(spark, [(-15, 0)]))
    assert m.assignment.count() == 6 and all(m.train(k, p).count() >= 2 for k in (1, 4))


def test_metrics(spark):
    d = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, yhat double")
    r = metrics.regression_metrics(d, p=1).first()
    assert r.n == 3 and r.MAE == pytest.approx(0.5) and r.R2 == pytest.approx(1 - 1.25 / (14 / 3))


def test_crps(spark):
    d = spark.createDataFrame([([5.0] * 50, y) for y in (3.0, 5.0, 8.0)], "draws array<double>, y double")
    assert [r[0] for r in d.select(metrics.crps_energy("draws", "y")).collect()] == [2.0, 0.0, 3.0]


def test_downdated_cv_equals_refits(spark):
    rng = np.random.default_rng(1)
    xy, a = cloud(40), rng.normal(size=40)
    z = 3 * a + xy[:, 0] + rng.normal(size=40) + 1e6
    p = points(spark, xy, a=a.tolist(), z=z.tolist())
    f = folds.random_folds(p, 4)
    fast = {r.row_id: r.yhat for r in cv.cv_ols(p, "z", ["a", "x"], f).collect()}
    _, slow, _ = cv.cv_spatial(p, "z", f, lambda t: models.fit_ols(t, "z", ["a", "x"]))
    for r in slow.collect():
        assert fast[r.row_id] == pytest.approx(r.yhat, rel=1e-9)


def test_forward_selection_finds_signal(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=(3, 80))
    p = points(spark, cloud(80), a=a.tolist(), b=b.tolist(), c=c.tolist(), z=(3 * a + 2 * b + rng.normal(size=80) * 0.1).tolist())
    chosen, score, history = cv.select_forward(p, "z", ["c", "b", "a"], folds.random_folds(p, 4), max_vars=2)
    assert chosen == ["a", "b"] and len(history) == 5 and score < 0.5


def test_moran_against_numpy(spark):
    xy, rng = cloud(40), np.random.default_rng(7)
    e = rng.normal(size=40)
    p = points(spark, xy, e=e.tolist())
    r = autocorr.morans_i(p.select("row_id", "e"), autocorr.knn_weights(p, 4)).first()
    w = np.zeros((40, 40))
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    for i in range(40):
        w[i, [j for j in np.argsort(d[i]) if j != i][:4]] = 0.25
    c = e - e.mean()
    assert r.I == pytest.approx(40 / w.sum() * (w * np.outer(c, c)).sum() / (c @ c))
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    n, s0, b2 = 40, w.sum(), (c**4).mean() / (c**2).mean() ** 2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2
    assert r.variance == pytest.approx(var, abs=1e-10)
    assert autocorr.p_value(0.0) == pytest.approx(0.5)


def test_range_is_recovered(spark):
    rng = np.random.default_rng(11)
    xy = rng.random((250, 2)) * 300
    h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    z = np.linalg.cholesky(np.exp(-h / (80 / 3)) + 1e-8 * np.eye(250)) @ rng.normal(size=250) + rng.normal(size=250) * 0.05
    r = autocorr.sac_range(points(spark, xy, z=z.tolist()), "z")
    assert 30 < (r.value or r.rejected) < 250
    assert autocorr.sac_range(points(spark, xy[:20], z=z[:20].tolist()), "z").value is None


def test_applicability_values(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 4.0)], "row_id long, z0 double, z1 double")
    assert aoa.mean_pairwise(d, 2) == pytest.approx(4.0)
    got = {r.row_id: r.d for r in aoa.nearest_in_features(d, d, 2, F.col("a.row_id") != F.col("b.row_id")).collect()}
    assert got == {1: 4.0, 2: 3.0, 3: 3.0}
    di = lambda v: aoa.threshold(spark.createDataFrame([(x,) for x in v], "di double")).first()[0]
    assert di([1.0] * 9 + [10.0]) == 1.0 and di([1.0, 2.0, 3.0, 4.0, 5.0]) == 5.0


def test_normalizer_is_over_all_pairs(spark, monkeypatch):
    """Also of more rows than the 5,000 that were drawn, and however many parts the rows are dealt to."""
    line = spark.range(6000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("z0"), F.lit(0.0).alias("z1"))
    assert aoa.mean_pairwise(line, 2) == pytest.approx(6001 / 3, rel=1e-12)
    monkeypatch.setattr(aoa, "PART", 500)
    monkeypatch.setattr(aoa, "CELLS", 100)
    assert aoa.mean_pairwise(line.limit(900), 1) == pytest.approx(901 / 3, rel=1e-12)
    assert aoa.mean_pairwise(line.limit(2), 1) == 1.0
    with pytest.raises(ValueError):
        aoa.mean_pairwise(line.limit(1), 1)


def test_gwr_paths_agree(spark):
    rng = np.random.default_rng(5)
    xy, a = cloud(60), rng.normal(size=60)
    p = points(spark, xy, a=a.tolist(), z=(a * xy[:, 0] + rng.normal(size=60)).tolist())
    one = {r.row_id: r.slope for r in models.gwr_one_predictor(p, "z", "a", 60.0).collect()}
    fit = models.fit_gwr(p, "z", ["a"], 60.0, adaptive=False)
    for r in fit.coef().collect():
        assert one[r.row_id] == pytest.approx(r.a, rel=1e-6)
    assert models.fallback_bandwidth(3, True) == 10 and models.fallback_bandwidth(30, True) == 27 and models.fallback_bandwidth(200, True) == 50
    with pytest.raises(ValueError):
        models.fit_gwr(p.withColumn("z", F.col("row_id") % 2), "z", ["a"])


def test_forest_and_surface(spark):
    rng = np.random.default_rng(6)
    xy, a = cloud(80), rng.normal(size=80)
    p = points(spark, xy, a=a.tolist(), z=(2 * a + rng.normal(size=80) * 0.1).tolist())
    fit = models.fit_forest(p, "z", ["a", "y"], trees=25)
    assert fit.info["importance"]["a"] > fit.info["importance"]["y"]
    assert fit.metrics().first()["R2"] > 0.6
    assert [r.pred for r in fit.predict(p.limit(5)).orderBy("row_id").collect()] == [r.pred for r in models.fit_forest(p, "z", ["a", "y"], trees=25).predict(p.limit(5)).orderBy("row_id").collect()]
    s = surface.predict_surface(fit, cell_size=20.0, covariates=p)
    assert s.count() == s.where("pred is not null").count() > 0
    with pytest.raises(NotImplementedError):
        fit.coef()


def test_gp_beats_the_mean(spark):
    rng = np.random.default_rng(8)
    xy = cloud(150)
    z = np.sin(xy[:, 0] / 15) + np.cos(xy[:, 1] / 20) + rng.normal(size=150) * 0.1
    fit = models.fit_gp(points(spark, xy, z=z.tolist()), "z", [], k=10, chains=2, iterations=300)
    assert fit.metrics().first()["R2"] > 0.8


def test_prep_and_dedup(spark):
    p = points(spark, [(1, 1), (1, 1), (2, 2)], a=[1.0, 2.0, float("inf")])
    assert [r.row_id for r in dedup_points(p).orderBy("row_id").collect()] == [1, 3]
    assert prep_model_data(Layer(p), None, ["a"], False).df.count() == 2
    with pytest.raises(ValueError):
        prep_model_data(Layer(p), "nope", ["a"])
    assert prediction_grid(spark, (0.0, 10.0, 0.0, 1.0), cell_size=3.0).count() == 3


def test_svg(spark):
    assert surface.svg_map(tessellate.square_grid(spark, (0.0, 1.0, 0.0, 1.0), 2, 2), "cell_id").count("<path") == 4


def test_stream_assignment(spark, tmp_path):
    from terrastat.streaming.scoring import stream_hex_cells, stream_square_cells

    points(spark, [(1, 1), (9, 9), (50, 1)]).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("row_id long, x double, y double").parquet(str(tmp_path / "in"))
    q = stream_square_cells(s, (0.0, 10.0, 0.0, 10.0), 2, 2).writeStream.format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.row_id: r.cell_id for r in spark.table("cells").collect()} == {1: 1, 2: 4, 3: None}
    assert "cell_id" in stream_hex_cells(s, (0.0, 10.0, 0.0, 10.0), 2.0).columns
