"""Representative points of geometries, all as column expressions.

Polygons are arrays of rings (even-odd), lines arrays of paths; both are arrays of arrays of x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, edges_of, shoelace
from ..sources.crs import forward, inverse, pick_local

MODES = ("auto", "centroid", "point_on_surface", "line_midpoint", "bbox_center")


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bbox_center(parts) -> Column:
    flat = F.flatten(F.col(parts))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return _xy((F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2)


def polygon_centroid(rings) -> Column:
    """Area-weighted centroid; the box centre where the area is 0."""
    edges = edges_of(rings)

    def moment(k):
        return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e[f"a{k}"] + e[f"b{k}"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))

    area = shoelace(rings)
    return F.when(area == 0, bbox_center(rings)).otherwise(_xy(moment("x") / (6 * area), moment("y") / (6 * area)))


def mean_point(parts) -> Column:
    flat = F.flatten(F.col(parts))
    mean = lambda k: F.aggregate(flat, F.lit(0.0), lambda s, p: s + p[k]) / F.size(flat)
    return _xy(mean("x"), mean("y"))


def surface_point(rings) -> Column:
    """A point inside: on the horizontal line through the middle of the box, the middle of its widest inner span."""
    box = bbox_center(rings)
    y = box["y"]
    cuts = F.array_sort(F.transform(F.filter(edges_of(rings), lambda e: (e["ay"] > y) != (e["by"] > y)), lambda e: e["ax"] + (y - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1)), F.lit(2)), lambda k: F.struct((F.get(cuts, k) - F.get(cuts, k - 1)).alias("w"), ((F.get(cuts, k) + F.get(cuts, k - 1)) / 2).alias("x")))
    return F.when(F.size(cuts) >= 2, _xy(F.array_max(spans)["x"], y)).otherwise(box)


def line_midpoint(paths) -> Column:
    """The point at half the length of the longest path."""
    def steps(p):
        return F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("d")))

    length = lambda s: F.aggregate(s, F.lit(0.0), lambda t, e: t + e["d"])
    best = F.array_max(F.transform(col(paths), lambda p: F.struct(length(steps(p)).alias("len"), p.alias("p"))))
    half = best["len"] / 2
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(s, e):
        t = (half - s["done"]) / F.nullif(e["d"], F.lit(0.0))
        here = s["x"].isNull() & (s["done"] + e["d"] >= half) & (e["d"] > 0)
        x = F.when(here, e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).otherwise(s["x"])
        y = F.when(here, e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).otherwise(s["y"])
        return F.struct((s["done"] + e["d"]).alias("done"), x.alias("x"), y.alias("y"))

    end = F.aggregate(steps(best["p"]), start, walk)
    only = F.get(best["p"], F.lit(0))
    return F.when(best["len"] > 0, _xy(end["x"], end["y"])).otherwise(_xy(only["x"], only["y"]))


def coerce_to_points(df: DataFrame, kind: str, parts: str = "rings", mode: str = "auto") -> DataFrame:
    """``df`` with ``x, y`` in place of a geometry column of one kind: polygon, line, multiline or multipoint.

    ``auto``: an inner point of polygons, the midpoint of lines (of the longest part), the mean of
    multipoints.
    """
    mode = {"surface": "point_on_surface"}.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "auto":
        mode = {"polygon": "point_on_surface", "line": "line_midpoint", "multiline": "line_midpoint"}.get(kind, "centroid")
    elif mode == "line_midpoint" and kind != "line":
        raise ValueError("line_midpoint takes single lines")
    if mode == "bbox_center":
        p = bbox_center(parts)
    elif mode == "line_midpoint":
        p = line_midpoint(parts)
    elif mode == "point_on_surface" and kind == "polygon":
        p = surface_point(parts)
    else:
        p = polygon_centroid(parts) if kind == "polygon" else mean_point(parts)
    return df.withColumn("__p", p).select(*[c for c in df.columns if c not in (parts, "x", "y")], F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


KINDS = ("point", "multipoint", "line", "multiline", "polygon", "multipolygon")


def assert_kinds(df: DataFrame, kinds, kind_col: str = "kind", name: str = "the layer") -> DataFrame:
    """``df``, if it has a ``kind_col`` and no geometry of a kind other than ``kinds``; else a ValueError that names them."""
    if kind_col not in df.columns:
        raise ValueError(f"{name} has no column {kind_col}")
    wanted = [kinds] if isinstance(kinds, str) else list(kinds)
    other = [r[0] for r in df.select(kind_col).distinct().where(F.col(kind_col).isNull() | ~F.col(kind_col).isin(wanted)).limit(10).collect()]
    if other:
        raise ValueError(f"{name} must be {' or '.join(wanted)}, not {', '.join(str(k) for k in other)}")
    return df


def coerce_mixed(df: DataFrame, parts: str = "rings", kind_col: str = "kind", mode: str = "auto", crs=None) -> DataFrame:
    """``df`` with ``x, y`` in place of a column of geometries of mixed kinds, each row by its own.

    ``auto`` takes an inner point of polygons, the midpoint of lines (of the longest part), the mean of multipoints and a
    point itself; ``centroid`` the centroid of polygons and the mean of other vertices; ``bbox_center`` the middle of the box;
    ``line_midpoint`` is for layers of single lines.  With ``crs`` in degrees midpoints are found in a projection that suits
    the layer's extent.  Geometries that are null or without vertices have no place; unknown kinds are an error.
    """
    mode = {"surface": "point_on_surface"}.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    assert_kinds(df, KINDS, kind_col)
    if mode == "line_midpoint":
        assert_kinds(df, "line", kind_col)
    kind, flat, columns = F.col(kind_col), parts, df.columns
    local = _local(df.where(kind.isin("line", "multiline")), parts) if crs is not None and crs.is_longlat and mode in ("auto", "line_midpoint") else None
    if local is None:
        middle = line_midpoint(parts)
    else:  # column by column: the expressions are long, and each is used many times
        df = df.withColumn("__lines", F.transform(parts, lambda r: F.transform(r, lambda v: _xy(*forward(local, v["x"], v["y"])))))
        df = df.withColumn("__mid", line_midpoint("__lines"))
        middle = _xy(*inverse(local, F.col("__mid.x"), F.col("__mid.y")))
    if mode == "bbox_center":
        p = bbox_center(flat)
    elif mode == "line_midpoint":
        p = middle
    else:
        inner = surface_point(flat) if mode in ("auto", "point_on_surface") else polygon_centroid(flat)
        p = F.when(kind.isin("polygon", "multipolygon"), inner)
        if mode == "auto":
            p = p.when(kind.isin("line", "multiline"), middle)
        p = p.otherwise(mean_point(flat))
    p = F.when(F.size(F.flatten(parts)) > 0, p)
    return df.withColumn("__p", p).select(*[c for c in columns if c not in (parts, "x", "y")], F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def _local(df: DataFrame, parts: str):
    """A projection that suits the lines' extent; None without lines."""
    x, y = F.transform(F.flatten(parts), lambda v: v["x"]), F.transform(F.flatten(parts), lambda v: v["y"])
    box = df.agg(F.min(F.array_min(x)), F.max(F.array_max(x)), F.min(F.array_min(y)), F.max(F.array_max(y))).first()
    return None if box[0] is None else pick_local(*box)
