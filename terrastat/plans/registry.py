"""Registered queries over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, lattice_order, path_length, perimeter, point_in_edges, shoelace
from ..operators import aoa as A
from ..operators import assign as S
from ..operators import autocorr as C
from ..operators import bayes as B
from ..operators import cv as V
from ..operators import folds as D
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import models as G
from ..operators import overlay as O
from ..operators import points as Q
from ..operators import seeding as R
from ..operators import polygons as Y
from ..operators import surface as P
from ..operators import tessellate as T
from ..operators.dealing import dealt
from ..operators.joins import distance_join, knn_join, nearest_join
from ..sources.crs import CRS, LONGLAT, WEBMERC, forward, harmonize_layers, reproject, utm
from ..sources.layer import Layer, dedup_points, prediction_grid, prep_model_data
from .layers import customer_lonlat, customer_points, embedding_points, lineitem_points, literal_cells

BOX = (-500.0, 500.0, -500.0, 500.0)
MODEL = [{"model": "Nug", "psill": 0.2, "range": 0.0}, {"model": "Exp", "psill": 0.8, "range": 60.0}]


def _r(df, digits=4, skip=()):
    """Doubles rounded: two engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _extent(points):
    return points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()


def _ell(spark, sf_dir):
    """An L over the customers' extent."""
    x0, x1, y0, y1 = _extent(customer_points(spark, sf_dir))
    xm, ym = x0 + 0.41 * (x1 - x0), y0 + 0.33 * (y1 - y0)
    return [np.array([[x0, y0], [x1, y0], [x1, ym], [xm, ym], [xm, y1], [x0, y1]])]


def _notched(spark, sf_dir):
    """A U over the customers' extent, open at the top."""
    x0, x1, y0, y1 = _extent(customer_points(spark, sf_dir))
    a, b, c = x0 + 0.3 * (x1 - x0), x0 + 0.7 * (x1 - x0), y0 + 0.25 * (y1 - y0)
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [b, y1], [b, c], [a, c], [a, y1], [x0, y1]])]


def _gridded(spark, sf_dir, nx=10, ny=10):
    p = lineitem_points(spark, sf_dir)
    x0, x1, y0, y1 = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def step(c, lo, hi, n):
        return F.greatest(F.lit(0), F.least(F.ceil((F.col(c) - lo) * (n / (hi - lo))) - 1, F.lit(n - 1))) if hi > lo else F.lit(0)

    return p.withColumn("cell_id", (step("y", y0, y1, ny) * nx + step("x", x0, x1, nx) + 1).cast("long"))


def cell_summary_square(spark, sf_dir):
    return _r(S.summarize_by_cell(_gridded(spark, sf_dir), "v", ["q"]), 6)


def cell_summary_fixed_deff(spark, sf_dir):
    return _r(S.summarize_by_cell(_gridded(spark, sf_dir), "v", [], deff=2.0, agg_funs={"mean": F.avg, "max": F.max}), 6)


def cell_summary_kish(spark, sf_dir):
    return _r(S.summarize_by_cell(_gridded(spark, sf_dir), "v", [], deff="kish"), 6)


def cell_summary_hex(spark, sf_dir):
    p = lineitem_points(spark, sf_dir)
    return _r(S.summarize_by_cell(p.withColumn("cell_id", T.hex_cell_of(F.col("x"), F.col("y"), (0.0, 2000.0, 0.0, 2000.0), 250.0)), "v", []), 6)


def cell_variogram_deff(spark, sf_dir):
    return _r(S.cell_design_effect(customer_points(spark, sf_dir), MODEL, "grp", order=lattice_order("row_id", 42)), 6)


def assign_smallest_area(spark, sf_dir):
    return S.assign_to_cells(customer_points(spark, sf_dir), literal_cells(spark)).select("row_id", "cell_id")


def assign_keep_unassigned(spark, sf_dir):
    return S.assign_to_cells(customer_points(spark, sf_dir), literal_cells(spark), keep_unassigned=True, tie_break="first").select("row_id", "cell_id")


def point_cell_index(spark, sf_dir):
    return S.point_cell_index(customer_points(spark, sf_dir), literal_cells(spark))


def voronoi_assign(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    return nearest_join(p, p.where("row_id % 50 = 0")).select(F.col("i").alias("row_id"), F.col("j").alias("cell_id"), F.round("d", 6).alias("d"))


def points_dedup(spark, sf_dir):
    return dedup_points(customer_points(spark, sf_dir), -2).select("row_id", "x", "y")


def stable_cell_ids(spark, sf_dir):
    g = T.stable_ids(T.square_grid(spark, _extent(customer_points(spark, sf_dir)), 7, 5))
    return g.select("cell_id", F.round("xmin", 6).alias("xmin"), F.round("ymin", 6).alias("ymin"), F.round(F.abs(shoelace("rings")), 4).alias("area"))


def grid_prediction_points(spark, sf_dir):
    return _r(prediction_grid(spark, _extent(customer_points(spark, sf_dir)), cell_size=30.0), 6)


def knn_weights(spark, sf_dir):
    return C.knn_weights(embedding_points(spark, sf_dir), 8)


def distance_pairs(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    # so many pairs that rounding by decimals, as ``round`` does, would be most of the work
    return distance_join(p, p, 20.0).select("i", "j", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("d"))


def knn_five(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    return _r(knn_join(p, p, 5, exclude_self=True), 6)


def morans_i(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return _r(C.morans_i(p.select("row_id", F.col("z").alias("e")), C.knn_weights(p, 8)), 8)


def variogram_omni(spark, sf_dir):
    return _r(C.variogram(embedding_points(spark, sf_dir), "z", 150.0, 10.0), 6)


def variogram_north(spark, sf_dir):
    return _r(C.variogram(embedding_points(spark, sf_dir), "z", 150.0, 10.0, azimuth=0.0), 6)


def folds_random(spark, sf_dir):
    return D.random_folds(customer_points(spark, sf_dir), 7, order=lattice_order("row_id", 42)).assignment


def folds_block(spark, sf_dir):
    return D.block_folds(customer_points(spark, sf_dir), 5).assignment


def folds_location(spark, sf_dir):
    order = (F.col("__g").cast("long") * 1103515245 + 42 * 12345) % 2147483648
    return D.location_folds(customer_points(spark, sf_dir), "grp", 4, order=order).assignment


def folds_buffered(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    f = D.buffered_loo(p, 50.0)
    gone = f.excluded.groupBy("fold").agg(F.count(F.lit(1)).alias("excluded"))
    return f.assignment.select("fold").join(gone, "fold", "left").select("fold", F.coalesce("excluded", F.lit(0)).cast("long").alias("excluded"))


def folds_nndm(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    grid = prediction_grid(spark, BOX, cell_size=100.0)
    u = (lattice_order("row_id", 7) + 0.5) / 2147483648
    return _r(D.nndm_folds(p, grid, draw=u).params["realised"].select(F.col("i").alias("row_id"), "radius", "realised"), 6)


def regression_metrics(spark, sf_dir):
    p = embedding_points(spark, sf_dir).withColumn("yhat", F.when(F.col("row_id") % 17 != 0, 0.01 * F.col("x") + 0.03 * F.col("y") + 48 * F.col("w1")))
    return _r(M.regression_metrics(p, "z", "yhat", 3), 6)


def cv_ols_folds(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    f = D.random_folds(p, 5, order=lattice_order("row_id", 42))
    return _r(V.cv_ols(p, "z", ["w1"], f), 6)


def cv_ols_metrics(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    f = D.random_folds(p, 5, order=lattice_order("row_id", 42))
    return _r(V.fold_metrics(V.cv_ols(p, "z", ["w1"], f)), 6)


def crps_coverage(spark, sf_dir):
    p = embedding_points(spark, sf_dir).withColumn("draws", F.transform(F.sequence(F.lit(1), F.lit(21)), lambda k: F.col("w1") * 50 + (k - 11) * 3.0))
    return _r(p.select("row_id", M.crps_energy("draws", "z").alias("crps"), M.covered("draws", "z", 0.8).alias("inside")), 6)


def aoa_new(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return _r(A.area_of_applicability(p.where("row_id % 5 = 0"), p.where("row_id % 5 <> 0"), ["w1", "w2", "w3"])[0], 6)


def aoa_train_folds(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    f = p.select("row_id", (F.col("row_id") % 4).alias("fold"))
    return _r(A.area_of_applicability(p.limit(0), p, ["w1", "w2"], {"w1": 3.0, "w2": 1.0}, folds=f)[1], 6)


def gwr_bisquare(spark, sf_dir):
    return _r(G.gwr_one_predictor(embedding_points(spark, sf_dir), "z", "w1", 250.0), 5)


def gwr_exponential(spark, sf_dir):
    return _r(G.gwr_one_predictor(embedding_points(spark, sf_dir), "z", "w1", 120.0, "exponential"), 5)


def gwr_adaptive(spark, sf_dir):
    return _r(G.gwr_one_predictor(embedding_points(spark, sf_dir), "z", "w1", 60, "tricube", adaptive=True), 5)


def _projected(spark, sf_dir, crs):
    x, y = forward(crs, F.col("x"), F.col("y"))
    return customer_lonlat(spark, sf_dir).select("row_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def project_utm(spark, sf_dir):
    return _projected(spark, sf_dir, utm(17))


def project_webmerc(spark, sf_dir):
    return _projected(spark, sf_dir, WEBMERC)


def project_albers(spark, sf_dir):
    return _projected(spark, sf_dir, CRS("albers", (29.5, 45.5, 37.5, -96.0)))


def project_laea(spark, sf_dir):
    return _projected(spark, sf_dir, CRS("laea", (35.0, -78.0)))


def surface_ols(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    grid = prediction_grid(spark, BOX, cell_size=50.0)
    return _r(P.predict_surface(G.fit_ols(p, "z", ["w1"]), grid, covariates=p).select("row_id", "w1", "pred"), 6)


def layer_from_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    return Layer.from_xy(d, "s_acctbal", "s_nationkey", order=[F.col("s_acctbal").desc(), F.col("s_suppkey")]).df.select("row_id", "x", "y", "s_suppkey")


def prepared_rows(spark, sf_dir):
    p = embedding_points(spark, sf_dir).withColumn("w1", F.when(F.col("row_id") % 13 != 0, F.col("w1"))).withColumn("z", F.when(F.col("row_id") % 11 == 0, F.lit(float("inf"))).when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return _r(prep_model_data(Layer(p, WEBMERC), "z", ["w1", "w2"]).df.select("row_id", "x", "y", "z"), 6)


def _boxes(spark, sf_dir):
    """A box for each customer: corner at its point, sides by its number."""
    d = customer_points(spark, sf_dir).select("row_id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 10 + F.col("row_id") % 90).alias("xmax"), (F.col("y") + 20 + F.col("row_id") % 70).alias("ymax"))
    ring = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))])
    return d.withColumn("rings", F.array(ring))


def polygon_measures(spark, sf_dir):
    """Right triangles at the customers' points."""
    d = dealt(customer_points(spark, sf_dir)).withColumns({"a": F.lit(3.0) + F.col("row_id") % 40, "b": F.lit(5.0) + F.col("row_id") % 30})
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    d = d.withColumn("rings", F.array(F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.col("a"), F.lit(0.0)), corner(F.lit(0.0), F.col("b")))))
    c, m, s = Q.polygon_centroid("rings"), Q.bbox_center("rings"), Q.surface_point("rings")
    return _r(d.select("row_id", shoelace("rings").alias("area"), perimeter("rings").alias("perimeter"), c["x"].alias("cx"), c["y"].alias("cy"), m["x"].alias("mx"), m["y"].alias("my"), s["x"].alias("sx"), s["y"].alias("sy")), 6)


def coerced_lines(spark, sf_dir):
    """Lines of two legs from the customers' points, by their midpoints."""
    d = customer_points(spark, sf_dir).withColumns({"a": F.lit(3.0) + F.col("row_id") % 40, "b": F.lit(5.0) + F.col("row_id") % 30})
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    d = d.withColumn("paths", F.array(F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.col("a"), F.lit(0.0)), corner(F.col("a"), F.col("b"))))).withColumn("length", path_length("paths"))
    return _r(Q.coerce_to_points(d.select("row_id", "length", "paths"), "line", "paths"), 6)


def assign_polygons_largest(spark, sf_dir):
    return Y.assign_polygons(_boxes(spark, sf_dir), literal_cells(spark), keep_unassigned=True).select("row_id", "cell_id")


def assign_polygons_smallest(spark, sf_dir):
    return Y.assign_polygons(_boxes(spark, sf_dir), literal_cells(spark), largest=False).select("row_id", "cell_id")


def polygon_overlaps(spark, sf_dir):
    return _r(Y.polygon_overlaps(_boxes(spark, sf_dir), literal_cells(spark)).select("feature_id", "cell_id", "overlap"), 6)


def cells_within_distance(spark, sf_dir):
    return J.polygon_matches(customer_points(spark, sf_dir).select("row_id", "x", "y"), literal_cells(spark), predicate="within_distance", distance=25.0).select("row_id", "cell_id")


def points_within_cells(spark, sf_dir):
    return J.polygon_matches(customer_points(spark, sf_dir).select("row_id", "x", "y"), literal_cells(spark), predicate="within").select("row_id", "cell_id")


def grid_clipped(spark, sf_dir):
    """A grid over an L, cut to it and numbered after that."""
    return Y.grid_polygons(spark, _ell(spark, sf_dir), cellsize=120.0).select("cell_id", F.round(F.abs(shoelace("rings")), 6).alias("area"), F.round("xmin", 6).alias("xmin"), F.round("ymin", 6).alias("ymin"))


def grid_by_target(spark, sf_dir):
    x0, x1, y0, y1 = _extent(customer_points(spark, sf_dir))
    edge = [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])]
    return Y.grid_polygons(spark, edge, target=24, clip=False).select("cell_id", F.round("xmin", 6).alias("xmin"), F.round("ymin", 6).alias("ymin"), F.round(F.abs(shoelace("rings")), 4).alias("area"))


def grid_pieces(spark, sf_dir):
    """Cells of a grid over a U: those that span its notch come in two rings, and no point of the notch lies in them."""
    cells = Y.grid_polygons(spark, _notched(spark, sf_dir), n=(3, 5))
    held = J.polygon_matches(customer_points(spark, sf_dir).select("row_id", "x", "y"), cells, predicate="within").groupBy("cell_id").agg(F.count(F.lit(1)).alias("inside"))
    out = cells.select("cell_id", F.size("rings").alias("n_rings"), F.round(F.abs(shoelace("rings")), 6).alias("area"))
    return out.join(held, "cell_id", "left").select("cell_id", "n_rings", "area", F.coalesce("inside", F.lit(0)).cast("long").alias("inside"))


def polygon_pieces(spark, sf_dir):
    """What the customers' boxes have in common with a U, piece by piece."""
    ring = [[(float(x), float(y)) for x, y in r] for r in _notched(spark, sf_dir)]
    flat = np.array(ring[0])
    cell = spark.createDataFrame([(1, ring, *flat.min(0).tolist(), *flat.max(0).tolist())], "cell_id long, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double")
    return Y.polygon_pieces(_boxes(spark, sf_dir), cell).select("feature_id", F.size("rings").alias("n_rings"), F.round("area", 6).alias("area"))


def polygons_repaired(spark, sf_dir):
    """Bow ties over the customers' boxes, with a vertex that comes twice and a spike."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    bow = F.array(at("xmin", "ymin"), at("xmax", "ymax"), at("xmax", "ymax"), at("xmax", "ymin"), at("xmin", "ymax"), at("xmin", "ymin"))
    fixed = O.repaired(_boxes(spark, sf_dir).withColumn("rings", F.array(bow)))
    return fixed.select("row_id", F.size("rings").alias("n_rings"), F.round(shoelace("rings"), 5).alias("area"), F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


def polygons_buffered(spark, sf_dir):
    """The customers' boxes grown by 7.5, and shrunk by 12 where something is left of them."""
    boxes = _boxes(spark, sf_dir)
    out = O.buffered(boxes, 7.5).withColumn("reach", F.lit(7.5)).unionByName(O.buffered(boxes, -12.0).withColumn("reach", F.lit(-12.0)))
    return out.select("row_id", "reach", F.size("rings").alias("n_rings"), F.round(F.coalesce(shoelace("rings"), F.lit(0.0)), 4).alias("area"), F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


def polygons_dissolved(spark, sf_dir):
    """The union of the customers' boxes by nation."""
    boxes = _boxes(spark, sf_dir).join(customer_points(spark, sf_dir).select("row_id", "grp"), "row_id")
    return O.dissolve(boxes, "grp").select("grp", F.round(shoelace("rings"), 4).alias("area"), "xmin", "ymin", "xmax", "ymax")


def clip_target_area(spark, sf_dir):
    """Clip targets: the box, the box grown by 10%, a U grown by 25."""
    p, rows = customer_points(spark, sf_dir), []
    for name, rings in (("box", T.clip_target(p)), ("grown", T.clip_target(p, expand=0.1)), ("notched", T.clip_target(p, _notched(spark, sf_dir), 25.0))):
        rows.append((name, len(rings), O.signed_area(rings)))
    return _r(spark.createDataFrame(rows, "target string, n_rings int, area double"), 4)


def voronoi_clipped(spark, sf_dir):
    """Voronoi cells of all customers in a U, tried at the points of a lattice: its own cell holds each point of the U."""
    cells, _ = T.create_voronoi(customer_points(spark, sf_dir), _notched(spark, sf_dir))
    x0, x1, y0, y1 = _extent(customer_points(spark, sf_dir))
    grid = prediction_grid(spark, (x0 + 0.137, x1, y0 + 0.211, y1), cell_size=23.17)
    seeds = dedup_points(customer_points(spark, sf_dir)).select(F.col("row_id").alias("seed"), "x", "y")
    owner = J.polygon_matches(seeds.select(F.col("seed").alias("row_id"), "x", "y"), cells).select(F.col("row_id").alias("seed"), "cell_id")
    # seeds outside the U own cells too: those are told by the nearest seed of the point
    met = J.polygon_matches(grid, cells).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_cells"), F.min("cell_id").alias("cell_id"))
    return met.join(owner, "cell_id", "left").select("row_id", "n_cells", F.coalesce("seed", F.lit(-1)).cast("long").alias("seed"))


def clip_extent(spark, sf_dir):
    x0, x1, y0, y1 = T.clip_box(customer_points(spark, sf_dir), 0.1)
    return spark.createDataFrame([(x0, x1, y0, y1)], "x0 double, x1 double, y0 double, y1 double").select(*[F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


def reprojected(spark, sf_dir):
    """From degrees to each system and back, by way of another."""
    p, out = customer_lonlat(spark, sf_dir), None
    for name, crs in (("utm", utm(17)), ("webmerc", WEBMERC), ("albers", CRS("albers", (29.5, 45.5, 37.5, -96.0))), ("laea", CRS("laea", (35.0, -78.0)))):
        d = reproject(reproject(reproject(p, LONGLAT, crs), crs, utm(17)), utm(17), LONGLAT)
        d = d.select("row_id", F.lit(name).alias("system"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
        out = d if out is None else out.unionByName(d)
    return out


def harmonized(spark, sf_dir):
    """Two layers in the system of the second."""
    p = customer_lonlat(spark, sf_dir)
    a, b, crs = harmonize_layers(p.where("row_id % 2 = 0"), LONGLAT, reproject(p.where("row_id % 2 = 1"), LONGLAT, utm(17)), utm(17), prefer="b")
    return _r(a.withColumn("layer", F.lit("a")).unionByName(b.withColumn("layer", F.lit("b"))).withColumn("system", F.lit(crs.kind)), 3)


def nearest_distance(spark, sf_dir):
    return _r(nearest_join(prediction_grid(spark, BOX, cell_size=50.0), embedding_points(spark, sf_dir)).select(F.col("i").alias("row_id"), "d"), 6)


def ranks_with_ties(spark, sf_dir):
    d = customer_points(spark, sf_dir).withColumn("v", F.floor(F.col("z") / 500))
    rank, ties = average_rank(Window.partitionBy("grp").orderBy("v"), Window.partitionBy("grp", "v"))
    return d.select("row_id", (rank + (ties - 1) / 2).alias("rank"))


def cell_summary_all_cells(spark, sf_dir):
    """Every cell has a row, those without points too."""
    p = customer_points(spark, sf_dir)
    cells = literal_cells(spark).unionByName(literal_cells(spark).where("cell_id = 2").withColumn("cell_id", F.lit(9).cast("long")).withColumn("xmin", F.col("xmin") + 5000).withColumn("xmax", F.col("xmax") + 5000).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda v: F.struct((v["x"] + 5000).alias("x"), v["y"].alias("y"))))))
    s = S.summarize_by_cell(S.assign_to_cells(p, cells), "z", cells=cells)
    return _r(s.select("cell_id", "n", "resp_mean_z", "sd_resp_z", "se_resp_z", "cell_weight"), 6)


def cell_summary_variogram(spark, sf_dir):
    return _r(S.summarize_by_cell(customer_points(spark, sf_dir), "z", [], "grp", deff="variogram", structures=MODEL, deff_order=lattice_order("row_id", 42)), 6)


def cv_ols_overall(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return _r(V.overall_metrics(V.cv_ols(p, "z", ["w1"], D.random_folds(p, 5, order=lattice_order("row_id", 42)))), 6)


def folds_remapped(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    f = D.remap_folds(D.random_folds(p, 7, order=lattice_order("row_id", 42)), p.where("z > 0"))
    return f.assignment.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def folds_without_rows(spark, sf_dir):
    """Train sizes of buffered folds: all rows but the test row and its excluded ones."""
    p = embedding_points(spark, sf_dir)
    f = D.buffered_loo(p, 80.0)
    out = f.assignment.select("fold").crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n"))))
    gone = f.excluded.groupBy("fold").agg(F.count(F.lit(1)).alias("m"))
    return out.join(gone, "fold", "left").select("fold", (F.col("n") - 1 - F.coalesce("m", F.lit(0))).alias("n_train"))


def ols_predictions(spark, sf_dir):
    """Rows without a predictor stay, without a prediction."""
    p = embedding_points(spark, sf_dir)
    fit = G.fit_ols(p.where("row_id % 3 <> 0"), "z", ["w1", "w2"])
    return _r(fit.predict(p.withColumn("w1", F.when(F.col("row_id") % 17 != 0, F.col("w1")))), 6)


def ols_metrics(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return _r(G.fit_ols(p, "z", ["w1"]).metrics(), 6)


def residual_moran(spark, sf_dir):
    r = V.residual_morans({"linear": G.fit_ols(embedding_points(spark, sf_dir), "z", ["w1"])}, 8)
    return _r(spark.createDataFrame([(x["model"], x["n"], x["I"], x["z"]) for x in r], "model string, n long, moran double, z double"), 6)


def gp_basis(spark, sf_dir):
    """Bounds of the length scales of a layer, and the basis that they ask for, from 1,000 shuffled points as in the reference."""
    p = embedding_points(spark, sf_dir).select("row_id", "x", "y").orderBy(lattice_order("row_id", 42), "row_id").limit(1000)
    lo, hi = G.lengthscale_bounds_of(p)
    k, c, capped = G.basis_spec(500.0, (lo, hi))
    return _r(spark.createDataFrame([(lo, hi, k, c, capped)], "low double, high double, k int, c double, capped boolean"), 6)


def gwr_fit_local(spark, sf_dir):
    return _r(G.fit_gwr(embedding_points(spark, sf_dir), "z", ["w1", "w2"], 80).coef())


# no SQL: iterative or random kernels


def forest_oob(spark, sf_dir):
    return G.fit_forest(embedding_points(spark, sf_dir), "z", ["x", "y", "w1", "w2"]).fitted()


def gp_fitted(spark, sf_dir):
    return G.fit_gp(embedding_points(spark, sf_dir), "z", ["w1", "w2"]).fitted()


def assign_nearest_centroid(spark, sf_dir):
    """Every customer has a cell: of those that hold it the smallest, else that of the nearest centroid."""
    return S.assign_to_cells(customer_points(spark, sf_dir), literal_cells(spark), fallback="centroid").select("row_id", "cell_id")


def points_by_own_predicate(spark, sf_dir):
    """Points inside a cell and at least 15 from its edges, a condition of the user's own."""
    deep = lambda x, y, e: point_in_edges(x, y, e) & F.forall(e, lambda s: J.edge_distance2(x, y, s) >= 225)
    return J.polygon_matches(customer_points(spark, sf_dir).select("row_id", "x", "y"), literal_cells(spark), predicate=deep).select("row_id", "cell_id")


def layer_quantiles(spark, sf_dir):
    """Type-7 quantiles of account balances by ranges, no task with all values."""
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = J.quantiles(customer_points(spark, sf_dir), "z", at)
    return _r(spark.createDataFrame(list(zip(at, found)), "p double, value double"), 6)


def gwr_condition(spark, sf_dir):
    """Condition numbers of two predictors among the 40 nearest rows."""
    return _r(G.gwr_condition(embedding_points(spark, sf_dir), ["w1", "w2"], 40), 5)


def coerced_mixed(spark, sf_dir):
    """Points, lines of two legs and right triangles in one layer, by the customers' numbers."""
    d = customer_points(spark, sf_dir).withColumns({"a": F.lit(3.0) + F.col("row_id") % 40, "b": F.lit(5.0) + F.col("row_id") % 30})
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    zero = F.lit(0.0)
    third = F.col("row_id") % 3
    path = [corner(zero, zero), corner(F.col("a"), zero)]
    rings = F.when(third == 0, F.array(F.array(path[0]))).when(third == 1, F.array(F.array(*path, corner(F.col("a"), F.col("b"))))).otherwise(F.array(F.array(*path, corner(zero, F.col("b")))))
    d = d.select("row_id", F.when(third == 0, "point").when(third == 1, "line").otherwise("polygon").alias("kind"), rings.alias("rings"))
    return _r(Q.coerce_mixed(d), 6)


def cell_summary_own(spark, sf_dir):
    """A trimmed mean of the user's own beside built-in aggregates."""
    def trimmed(v):
        cut = len(v) // 10
        return v.sort_values().iloc[cut : len(v) - cut].mean()

    funs = {"mean": F.avg, "top": F.max, "trimmed": S.Vectorised(trimmed), "odd": "no function"}
    return _r(S.summarize_by_cell(customer_points(spark, sf_dir), "z", [], "grp", agg_funs=funs).select("grp", "n", "resp_mean_z", "resp_top_z", "resp_trimmed_z", "resp_odd_z"), 5)


def random_points_inside(spark, sf_dir):
    """800 random points of a U over the customers' extent: none outside, each arm has its share."""
    ring = _notched(spark, sf_dir)[0]
    p = R.random_points(spark, [ring], 800)
    (x0, y0), (x1, y1), (a, c), (b, _) = ring[0], ring[2], ring[5], ring[4]
    x, y = F.col("x"), F.col("y")
    outside = ~(x.between(x0, x1) & y.between(y0, y1)) | ((x > a) & (x < b) & (y > c))
    left = (a - x0) * (y1 - c) / ((x1 - x0) * (y1 - y0) - (b - a) * (y1 - c))
    return p.agg(F.count_distinct("point_id").alias("n"), F.sum(outside.cast("long")).alias("outside"), (F.abs(F.avg(((x <= a) & (y > c)).cast("double")) - left) < 0.07).alias("even"))


def seeds_kmeans_inside(spark, sf_dir):
    """Twelve k-means seeds of a random cloud in an L lie in its box; provided ones are numbered."""
    edge = _ell(spark, sf_dir)
    s = R.voronoi_seeds(spark, edge, "kmeans", 12, starts=2)
    given = R.voronoi_seeds(spark, None, "provided", seeds=customer_points(spark, sf_dir))
    low, high = edge[0].min(0), edge[0].max(0)
    within = F.col("x").between(float(low[0]), float(high[0])) & F.col("y").between(float(low[1]), float(high[1]))
    both = s.unionByName(given)
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.max("seed_id").alias("last"), F.sum(within.cast("long")).alias("within"))


def gp_recovered(spark, sf_dir):
    """What a Gaussian process finds of the plan that the embeddings' response follows: slopes, fit, agreement of chains."""
    p = embedding_points(spark, sf_dir)
    fit = G.fit_gp(p, "z", ["w1", "w2"])
    slopes = fit.coef()
    out = fit.metrics().select("n", F.round("R2", 3).alias("r2"))
    return out.withColumns({"slope_w1": F.lit(round(slopes["w1"][0], 1)), "slope_w2": F.lit(round(slopes["w2"][0], 1)), "chains_agree": F.lit(bool(max(fit.info["rhat"]) < 1.05))})


def gp_loo(spark, sf_dir):
    """Leave-one-out terms of a Gaussian process for a coarser response: labels as counts."""
    p = embedding_points(spark, sf_dir).withColumn("count", F.col("grp").cast("double"))
    return G.fit_gp(p, "count", ["w1", "w2"], family="poisson", k=10, iterations=1000).loo()


def _log_lik(spark, sf_dir):
    lik = lambda k: -0.5 * F.pow(5 * F.col("w2") - ((k * 37) % 60 - 29.5) / 20 * (1 + F.col("w3") * F.col("w3")), F.lit(2.0)) - 0.9189385332046727
    return embedding_points(spark, sf_dir).select("row_id", F.transform(F.sequence(F.lit(1), F.lit(60)), lik).alias("log_lik"))


def psis_loo(spark, sf_dir):
    """Leave-one-out terms from 60 draws of a normal model by row."""
    return _r(B.psis_loo(_log_lik(spark, sf_dir)), 5)


def loo_summary(spark, sf_dir):
    """The same terms added up."""
    return _r(B.loo_summary(B.psis_loo(_log_lik(spark, sf_dir)), 0.5), 3)


def voronoi_cells(spark, sf_dir):
    p = dedup_points(customer_points(spark, sf_dir))
    edge = np.array([[0.0, 0.0], [1000.0, 0.0], [1000.0, 1009.0], [0.0, 1009.0]])
    return T.voronoi_cells(p, edge).select("cell_id", F.round(F.abs(shoelace("rings")), 6).alias("area"))


def delaunay_triangles(spark, sf_dir):
    """Triangles of the embeddings' points, which lie in no pattern."""
    from ..operators.triangulate import delaunay_triangles as made

    return made(dedup_points(embedding_points(spark, sf_dir))).select("a", "b", "c", F.round(F.abs(shoelace("rings")), 6).alias("area"))


def kmeans_seeds(spark, sf_dir):
    return T.kmeans_seeds(customer_points(spark, sf_dir), 8)


def forward_selection(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    chosen, score, history = V.select_forward(p, "z", ["w1", "w2", "w3"], D.random_folds(p, 4))
    return spark.createDataFrame([(h["step"], h["candidate"], float(h["RMSE"])) for h in history], "step int, candidate string, rmse double")


def sac_range(spark, sf_dir):
    r = C.sac_range(embedding_points(spark, sf_dir), "z")
    return r.variogram


def queries():
    from types import FunctionType

    skip = {"queries"}
    return {k: f for k, f in globals().items() if isinstance(f, FunctionType) and f.__module__ == __name__ and not k.startswith("_") and k not in skip}
