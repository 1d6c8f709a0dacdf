"""Work that grows with a layer is dealt over tasks and takes short ways where they are exact."""

import numpy as np
from pyspark.sql import functions as F

from terrastat.operators import overlay as O
from terrastat.operators import polygons as Y

BOX = "row_id long, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"


def _convex(rng, n):
    t = np.sort(rng.random(n)) * 2 * np.pi
    return rng.normal(0, 3, 2) + np.column_stack([4 * np.cos(t), 3 * np.sin(t)])


def _boxes(spark, corners):
    rows = [(i, [[(a, b), (c, b), (c, d), (a, d)]], a, b, c, d) for i, (a, b, c, d) in enumerate(corners)]
    return spark.createDataFrame(rows, BOX).coalesce(1)


def test_convex_ways_equal_the_general_ones():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, q = _convex(rng, 3 + int(rng.integers(7))), _convex(rng, 3 + int(rng.integers(7)))[::-1]
        if O.convex([p]) is None or O.convex([q]) is None:
            continue
        odd = lambda w: w[:, 0] % 2 == 1
        assert np.isclose(O.signed_area(O.make_valid([q])), O.signed_area(O.arrange([[q]], odd)))
        assert np.isclose(Y.overlap_area([p], [q]), O.signed_area(O.overlay([p], [q])), atol=1e-9)
        assert np.isclose(O.signed_area(O.common([p], O.make_valid([q]))), O.signed_area(O.overlay([p], [q])), atol=1e-9)
        # a repeated corner takes the general way
        same = np.vstack([p[:1], p])
        for d in (0.7, -0.4, -1.5):
            assert O.convex([same]) is None
            assert np.isclose(O.signed_area(O.buffer([p], d)), O.signed_area(O.arrange([[_curve(p, d)]], lambda w: w[:, 0] > 0)), atol=1e-8)


def _curve(ring, distance, segments=30):
    """The offset curve of a ring, counter-clockwise, corner by corner."""
    ring = np.array(O.convex([ring]))
    d = np.roll(ring, -1, 0) - ring
    d = d / np.hypot(*d.T)[:, None]
    out, turn = np.column_stack([d[:, 1], -d[:, 0]]) * distance, np.roll(d, 1, 0)
    bend = np.arctan2(turn[:, 0] * d[:, 1] - turn[:, 1] * d[:, 0], (turn * d).sum(1))
    before, curve = np.roll(out, 1, 0), []
    for k, corner in enumerate(ring):
        if distance > 0:
            t = np.linspace(0, bend[k], max(1, int(np.ceil(bend[k] / (np.pi / 2) * segments - 1e-9))) + 1)
            c, s = np.cos(t), np.sin(t)
            curve.append(corner + np.column_stack([before[k, 0] * c - before[k, 1] * s, before[k, 0] * s + before[k, 1] * c]))
        else:
            curve.append(np.array([corner + before[k], corner, corner + out[k]]))
    return np.vstack(curve)


def test_a_star_is_not_convex():
    t = np.arange(5) * 4 * np.pi / 5
    star = np.column_stack([np.cos(t), np.sin(t)])
    assert O.convex([star]) is None and O.convex([star[[0, 3, 1, 4, 2]]]) is not None


def test_features_of_one_partition_are_dealt(spark):
    boxes = _boxes(spark, [(k, 0.0, k + 2.0, 3.0) for k in map(float, range(40))])
    cells = _boxes(spark, [(0.0, 0.0, 20.0, 2.0), (20.0, 0.0, 50.0, 2.0)]).withColumnRenamed("row_id", "cell_id")
    for out in (O.repaired(boxes), O.buffered(boxes, 1.0), Y.polygon_pieces(boxes, cells), Y.polygon_overlaps(boxes, cells)):
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert np.isclose(Y.polygon_pieces(boxes, cells).agg(F.sum("area")).first()[0], 40 * 2 * 2 - 0.0)


def test_union_of_deep_boxes_by_tiles(spark):
    """Whole tiles, covered features and seams: the area of the union, counted on a lattice."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 40, (300, 2)).astype(float)
    b = a + rng.integers(1, 15, (300, 2))
    lattice = np.zeros((60, 60), bool)
    for (x0, y0), (x1, y1) in zip(a.astype(int), b.astype(int), strict=True):
        lattice[x0:x1, y0:y1] = True
    layer = _boxes(spark, [(*p, *q) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    for tile in (None, 3.0, 50.0):
        rows = O.dissolve(layer.withColumn("g", (F.col("row_id") * 0).cast("int")), "g", tile).collect()
        assert len(rows) == 1 and np.isclose(O.signed_area(O.arrays(rows[0]["rings"])), lattice.sum())


def test_union_drops_covered_shapes_only():
    big, small, cross = [np.array([[0, 0], [9, 0], [9, 9], [0, 9.0]])], [np.array([[1, 1], [2, 1], [1, 2.0]])], [np.array([[5, 5], [12, 5], [5, 12.0]])]
    dart = [np.array([[0, 0], [9, 0], [3, 3], [0, 9.0]])]
    assert len(O._uncovered([small, big, cross])) == 2
    assert len(O._uncovered([dart, [r + [4, 4] for r in small]])) == 2


def test_local_fits_beyond_the_sent_rows(spark):
    from terrastat.operators import models as G

    rng = np.random.default_rng(8)
    n = 120
    v = rng.normal(size=(n, 5))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "row_id long, x double, y double, w double, u double, z double")
    for b, adaptive in ((30, True), (1.5, False)):
        sent, joined = (G.fit_gwr(d, "z", ["w", "u"], b, adaptive, max_train=m).local().orderBy("row_id").toPandas() for m in (n, n - 1))
        assert np.allclose(np.stack(sent["beta"]), np.stack(joined["beta"])) and np.allclose(sent["hat"], joined["hat"]) and len(joined) == n


def test_local_lines_by_blocks_equal_those_of_pairs(spark):
    from terrastat.operators import models as G

    rng = np.random.default_rng(9)
    v = np.column_stack([rng.random((150, 2)) * 3, rng.normal(size=(150, 2))])
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "row_id long, x double, y double, u double, z double")
    d2 = ((v[:, None, :2] - v[None, :, :2]) ** 2).sum(2)
    for kernel in ("bisquare", "exponential", "boxcar"):
        out = G.gwr_one_predictor(d, "z", "u", 1.3, kernel)
        assert not [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "sqrt" in n.lower()]  # no pairs as rows
        w, x = G.kernel_values(np.sqrt(d2), 1.3, kernel), np.column_stack([np.ones(150), v[:, 2]])
        for r in out.collect():
            beta = np.linalg.solve(x.T @ (w[r.row_id][:, None] * x), x.T @ (w[r.row_id] * v[:, 3]))
            assert np.allclose([r.intercept, r.slope], beta)


def test_pairs_and_measures_are_dealt(spark):
    from terrastat.operators.joins import distance_join
    from terrastat.plans import registry

    p = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y")).coalesce(1)
    near = distance_join(p, p, 1.0)
    assert near.count() == 400 + 4 * 20 * 19 and near.rdd.getNumPartitions() > 4
    assert registry.polygon_measures(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_bins_around_points_are_made_after_the_shuffle(spark):
    """A row was nine on disk; now it is one on the left, and one a tile near it on the right."""
    from terrastat.operators.joins import distance_join

    rng = np.random.default_rng(6)
    xy = np.round(np.vstack([rng.normal(0, 30, (150, 2)), rng.random((150, 2)) * 400 - 200]))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "row_id long, x double, y double")
    near = distance_join(p.where("row_id % 3 > 0"), p, 5.0)
    i, j = np.nonzero(((xy[:, None] - xy[None]) ** 2).sum(2) <= 25)
    got = [(r.i, r.j) for r in near.select("i", "j").collect()]
    assert sorted(got) == [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a % 3]
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 2 and plan.index("explode([-1,0,1])") < plan.index("Exchange")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = distance_join(p, p, 5.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange ") == 2


def test_subsets_of_large_cells_and_layers_as_in_their_sql(spark, tmp_path):
    """More points than the subsets hold: 600 a cell, 1,500 in a layer."""
    import duckdb

    from terrastat.plans import oracle, registry

    con = duckdb.connect()
    con.execute(f"copy (select i as c_custkey, 'c' as c_name, (i % 2)::int as c_nationkey, (i * 37 % 1000)::double as c_acctbal from range(1, 1201) t(i)) to '{tmp_path}/customer.parquet'")
    con.execute(f"copy (select i as vec_id, [(i * 7919 % 1009) / 2000, (i * 104729 % 997) / 2000, 0.1, 0.2, 0.3, 0.4]::float[] as embedding, 1 as label from range(1, 1501) t(i)) to '{tmp_path}/embeddings.parquet'")
    for t in ("customer", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("cell_variogram_deff", "cell_summary_variogram", "gp_basis"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(oracle.oracle_sql()[name]).fetchdf()[got.columns].sort_values(got.columns[0]).to_numpy(float)
        assert np.allclose(got.toPandas().sort_values(got.columns[0]).to_numpy(float), want, rtol=0, atol=2e-6), name


def test_matched_folds_rank_no_pairs(spark):
    """The neighbour closest to each radius without its pairs leaving their tasks; where it is the last of all, the one before."""
    from terrastat.operators.folds import nndm_folds

    rng = np.random.default_rng(4)
    xy = rng.random((40, 2)) * 10
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "row_id long, x double, y double")
    far = spark.createDataFrame([(0, 40.0, 40.0), (1, 5.0, 5.0)], "row_id long, x double, y double")
    f = nndm_folds(p, far)
    assert "Window" not in f.params["realised"]._jdf.queryExecution().optimizedPlan().toString()
    gone = {r["fold"]: r["n"] for r in f.excluded.groupBy("fold").agg(F.count("row_id").alias("n")).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    for r in f.params["realised"].collect():
        others = np.sort(np.delete(d[r.i], r.i))
        k = min(int(np.argmin(np.abs(others - r.radius))), 37)
        assert np.isclose(r.realised, others[k]) and gone.get(r.i, 0) == k


def test_voronoi_cells_by_blocks_equal_sent_ones(spark):
    from terrastat.functions.exprs import shoelace
    from terrastat.operators import tessellate as T

    rng = np.random.default_rng(3)
    # two far clusters, a ring of points, a lattice: blocks of one cluster reach cells of the other
    turn = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    xy = np.vstack([rng.normal(0, 1, (700, 2)), rng.normal(900, 2, (700, 2)), 400 + 90 * np.column_stack([np.cos(turn), np.sin(turn)]), np.stack(np.meshgrid(np.arange(20.0), 500 + np.arange(20.0)), 2).reshape(-1, 2)])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")
    edge = np.array([[-100.0, -100.0], [1000.0, -100.0], [1000.0, 1000.0], [-100.0, 1000.0]])

    def areas(**options):
        return {r.cell_id: r.a for r in T.voronoi_cells(p, edge, **options).select("cell_id", shoelace("rings").alias("a")).collect()}

    sent, blocks = areas(), areas(max_sent=0)
    assert sent.keys() == blocks.keys() and all(np.isclose(sent[k], blocks[k], rtol=1e-7, atol=1e-7) for k in sent)
    assert np.isclose(sum(blocks.values()), 1100.0**2)


def test_points_far_from_all_cells_meet_few_edges(spark):
    from terrastat.operators import joins as J

    rng = np.random.default_rng(4)
    low = np.vstack([rng.random((900, 2)) * [100, 10], rng.random((900, 2)) * [100, 10] + [0, 5000]])
    cells = _boxes(spark, np.hstack([low, low + 0.5]).tolist()).withColumnRenamed("row_id", "cell_id")
    xy = rng.random((200, 2)) * [200, 4000] + [-50, 500]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_id long, x double, y double")
    found = dict(J.nearest_polygon(p, cells).select("row_id", "cell_id").collect())
    gap = np.maximum(np.maximum(low[None] - xy[:, None], xy[:, None] - low[None] - 0.5), 0)
    assert found == dict(enumerate(np.hypot(gap[..., 0], gap[..., 1]).argmin(1).tolist()))
    # a bin that covers such a point would hold all edges of both bands
    tried = []
    kept, J.grow_nearest = J.grow_nearest, lambda *a, **k: tried.append(a)
    try:
        assert J.nearest_polygon(p, cells).count() == 200 and not tried
    finally:
        J.grow_nearest = kept


def test_trees_are_the_same_whether_orders_are_kept_or_sorted_anew(monkeypatch):
    from terrastat.operators import models as G

    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3)).round(1)
    y = x[:, 0] + rng.normal(size=900)
    trees = []
    for rows in (10**9, 256, 1):
        monkeypatch.setattr(G, "SORTED_ROWS", rows)
        trees.append(G._tree(x, y, np.random.default_rng(1), 2, 5))
    assert len(trees[0][0]) > 100
    for other in trees[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(trees[0], other, strict=True))


def test_kmeans_seeds_do_not_depend_on_the_files_partitions(spark):
    from terrastat.operators import tessellate as T

    rng = np.random.default_rng(7)
    xy = rng.integers(0, 60, (800, 2)).astype(float).tolist()
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(xy)], "row_id long, x double, y double")
    one, many = ([tuple(r) for r in T.kmeans_seeds(q, 6, starts=2, iterations=3).collect()] for q in (p.coalesce(1), p.orderBy("y").repartition(7)))
    assert one == many and len(one) == 6


def test_neighbours_in_features_are_dealt_by_bins(spark, monkeypatch):
    from terrastat.operators import aoa as A
    from terrastat.operators import joins as J

    rng = np.random.default_rng(8)
    z = rng.normal(size=(300, 2)).tolist()
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(z)], "row_id long, z0 double, z1 double")
    dealt, keys = J.dealt, []
    monkeypatch.setattr(J, "dealt", lambda df, *k: keys.append(k) or dealt(df, *k))
    found = dict(A.nearest_in_features(p, p, 2, F.col("a.row_id") != F.col("b.row_id")).collect())
    d = np.hypot(*(np.array(z)[:, None] - np.array(z)).transpose(2, 0, 1)) + np.diag(np.full(300, np.inf))
    assert np.allclose([found[i] for i in range(300)], d.min(1)) and len(keys) >= 2 and set(keys) == {("__bx", "__by")}


def test_posterior_rows_come_in_slices(spark):
    import pandas as pd

    from terrastat.operators import models as G

    info = {"mean": np.zeros(2), "sd": np.ones(2), "L": np.array([2.0, 2.0]), "k": 2, "draws": np.ones((3, 6)), "sigma": np.ones(3)}
    fit = G.GPFit("GP", "z", ["w"], None, info)
    d = spark.range(2500).coalesce(1).select(F.col("id").alias("row_id"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("w"))
    sizes = [r.n for r in fit._mapped(d, lambda f, eta, sigma: pd.DataFrame({"n": [len(f)]}), "n long").collect()]
    assert sum(sizes) == 2500 and max(sizes) <= 1000
