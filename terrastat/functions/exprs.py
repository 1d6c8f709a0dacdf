"""Column expressions that the operators share.  All are built-ins: nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # the spacing of doubles at 1


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """False for null, NaN and infinities: NaN compares greater than infinity."""
    return F.coalesce(F.abs(col(c).cast("double")) < F.lit(float("inf")), F.lit(False))


def finite_or_null(c) -> Column:
    return F.when(is_finite(c), col(c).cast("double"))


def nan_to_null(c) -> Column:
    """Null for NaN; infinities stay."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def all_finite(columns) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(c) for c in columns], F.lit(True))


def squared_distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return dx * dx + dy * dy


def hash_order(key, seed: int) -> Column:
    """A reproducible shuffle key: depends on (seed, row key) only, never on partitions."""
    return F.xxhash64(F.lit(int(seed)), col(key))


def lattice_order(key, seed: int) -> Column:
    """A shuffle key that SQL engines without xxhash64 can repeat; a bijection of ids below 2**31."""
    return (col(key) * F.lit(1103515245) + F.lit(int(seed) * 12345)) % F.lit(2147483648)


def quantile7(values, p) -> Column:
    """Type-7 quantile of a sorted array of doubles (null for an empty one)."""
    values, p = col(values), p if isinstance(p, Column) else F.lit(float(p))
    h = (F.size(values) - 1) * p
    low = F.floor(h).cast("int")
    a = F.get(values, low)
    b = F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (h - low) * (b - a)


def average_rank(order, tie) -> tuple[Column, Column]:
    """(rank, ties) windows for average-tie ranks: rank + (ties - 1) / 2."""
    return F.rank().over(order), F.count(F.lit(1)).over(tie)


def edges_of(rings) -> Column:
    """All edges ``(ax, ay, bx, by)`` of an array of rings (arrays of x, y structs), each ring closed."""
    def one(r):
        turned = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.zip_with(r, turned, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(col(rings), one))


def shoelace(rings) -> Column:
    """Signed area of an array of rings; holes wind the other way."""
    return F.aggregate(edges_of(rings), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def perimeter(rings) -> Column:
    """The length of all edges of an array of closed rings."""
    return F.aggregate(edges_of(rings), F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def path_length(paths) -> Column:
    """The length of an array of open paths."""
    def one(p):
        steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)

    return F.aggregate(F.transform(col(paths), one), F.lit(0.0), lambda s, d: s + d)


def point_in_edges(x, y, edges) -> Column:
    """Even-odd containment; points on an edge are inside."""
    x, y, edges = col(x), col(y), col(edges)
    on = F.exists(
        edges,
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    crossings = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return on | (F.size(crossings) % 2 == 1)
