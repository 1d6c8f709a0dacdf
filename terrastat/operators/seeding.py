"""Random points in polygons as a distributed source, and seeds of tessellations."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import edges_of, point_in_edges, shoelace
from .joins import global_rank
from .lineage import cut_lineage
from .overlay import RINGS, holds, make_valid, signed_area, structs
from .tessellate import kmeans_seeds

log = logging.getLogger("terrastat")
CHUNK = 10_000  # candidates of a part that are made in one row's task
ROUNDS = 10


def parts_of(boundary: list) -> list[list[np.ndarray]]:
    """The separate polygons of a boundary (rings): each an outer ring with its holes."""
    rings = make_valid(boundary)
    turn = [float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) for r in rings]
    parts = [[r] for r, t in zip(rings, turn, strict=True) if t > 0]
    for r, t in zip(rings, turn, strict=True):
        if t < 0:  # in the smallest outer ring that holds the hole's middle of an edge
            at = ((r[0] + r[1]) / 2)[None]
            outer = [p for p in parts if holds(at, [p[0]])[0]] or parts[:1]
            min(outer, key=lambda p: signed_area(p[:1])).append(r)
    return parts


def _uniform(*key):
    """A number in [0, 1) by its key."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)


def random_points(spark: SparkSession, boundary: list | DataFrame, n: int, seed: int = 456) -> DataFrame:
    """``point_id`` (from 1)``, x, y``: n points uniform in a boundary, rings or a layer of disjoint polygons (``rings``).

    Candidates are drawn in the box of each part, as many a unit of area everywhere, by hashes of seed, part and number; those
    inside are ranked by another hash and the first n stay.  Points do not depend on partitions.  Where n can't be reached in
    ``ROUNDS`` rounds of ever more candidates, fewer come, with a warning.
    """
    if n < 1:
        raise ValueError("at least one point")
    if isinstance(boundary, DataFrame):
        parts = boundary.select("rings")
    else:
        parts = spark.createDataFrame([(structs(p),) for p in parts_of(boundary)], f"rings {RINGS}")
    corner = F.flatten("rings")
    axes = [F.transform(corner, lambda v: v["x"]), F.transform(corner, lambda v: v["y"])]
    low, high = [F.array_min(a) for a in axes], [F.array_max(a) for a in axes]
    parts = parts.select(F.xxhash64("rings").alias("part"), edges_of("rings").alias("edges"), F.abs(shoelace("rings")).alias("area"), low[0].alias("x0"), low[1].alias("y0"), (high[0] - low[0]).alias("w"), (high[1] - low[1]).alias("h"))
    parts = cut_lineage(parts.where("area > 0"))
    area, box = parts.agg(F.sum("area"), F.sum(F.col("w") * F.col("h"))).first()
    if not area:
        raise ValueError("the boundary has no area")
    want = n * box / area
    for attempt in range(ROUNDS):
        density = (want + 4 * math.sqrt(want) + 16) * 1.1 * 1.5**attempt / box
        many = F.ceil(F.col("w") * F.col("h") * density)
        chunk = parts.withColumn("many", many).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / CHUNK))))
        chunk = chunk.repartition("part", "chunk")
        upto = F.least(F.col("many"), (F.col("chunk") + 1) * CHUNK) - 1
        made = chunk.withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, upto)))
        made = made.withColumns({"x": F.col("x0") + F.col("w") * _uniform(F.lit(seed), "part", "k", F.lit(1)), "y": F.col("y0") + F.col("h") * _uniform(F.lit(seed), "part", "k", F.lit(2))})
        inside = made.where(point_in_edges("x", "y", "edges")).select("x", "y", F.xxhash64(F.lit(seed), "part", "k", F.lit(3)).alias("__key"), "part", "k")
        ranked = global_rank(inside, "__key", "part", "k", name="__rank").where(F.col("__rank") < n)
        out = ranked.select((F.col("__rank") + 1).cast("long").alias("point_id"), "x", "y")
        found = out.count()
        if found == n:
            return out
    log.warning("only %d of %d points could be placed", found, n)
    return out


def voronoi_seeds(
    spark: SparkSession, boundary: list | None = None, method: str = "kmeans", n: int | None = None, seeds: DataFrame | None = None,
    sample_points: DataFrame | None = None, starts: int = 10, iterations: int = 100, seed: int = 456,
) -> DataFrame:
    """``seed_id, method, x, y``: seeds of a tessellation.

    ``provided`` numbers the given ones (``row_id, x, y``) in order of their ids; ``random`` are uniform in the boundary; ``kmeans``
    are centres of the sample points, or of a cloud of 50 n, at least 2,000, random points in the boundary.  More centres than
    places are cut to the places, with a warning.
    """
    if method not in ("kmeans", "random", "provided"):
        raise ValueError(f"unknown method: {method}")
    if method == "provided":
        if seeds is None:
            raise ValueError("the method needs seeds")
        out = global_rank(seeds.select("row_id", "x", "y"), "row_id", "x", "y", name="__rank").select((F.col("__rank") + 1).cast("long").alias("seed_id"), "x", "y")
    else:
        if n is None:
            raise ValueError(f"the method {method} needs n")
        if boundary is None and (method == "random" or sample_points is None):
            raise ValueError("the method needs a boundary")
        if method == "random":
            out = random_points(spark, boundary, n, seed).withColumnRenamed("point_id", "seed_id")
        else:
            cloud = sample_points if sample_points is not None else random_points(spark, boundary, max(2000, 50 * n), seed)
            places = cloud.select(F.round("x", 10), F.round("y", 10)).distinct().count()
            if places < n:
                log.warning("%d seeds asked for, %d places: clamped", n, places)
            out = cloud.select("x", "y").distinct().withColumn("seed_id", F.lit(1).cast("long")) if min(n, places) == 1 and places == 1 else kmeans_seeds(cloud, min(n, places), seed, starts, iterations)
    return out.select("seed_id", F.lit(method).alias("method"), "x", "y")
