"""Coordinate reference systems: descriptions on the driver, projections as column expressions."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("terrastat")
# WGS 84
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)


@dataclass(frozen=True)
class CRS:
    kind: str  # longlat, utm, albers, laea, webmerc, projected, none
    params: tuple = ()
    epsg: int | None = None

    @property
    def is_longlat(self) -> bool:
        return self.kind == "longlat"


LONGLAT, WEBMERC, NONE = CRS("longlat", epsg=4326), CRS("webmerc", epsg=3857), CRS("none")


def utm(zone: int, south: bool = False) -> CRS:
    return CRS("utm", (zone, south), (32700 if south else 32600) + zone)


def pick_local(lon_min, lon_max, lat_min, lat_max, lon0=None, lat0=None) -> CRS:
    """A projected system for a lon/lat box: UTM where a zone covers it, else an equal-area one."""
    if None in (lon_min, lon_max, lat_min, lat_max) or not all(map(math.isfinite, (lon_min, lon_max, lat_min, lat_max))):
        return WEBMERC
    if lon_max - lon_min > 180:
        log.warning("the layer spans more than 180 degrees: using web Mercator")
        return WEBMERC
    lon0 = (lon_min + lon_max) / 2 if lon0 is None else lon0
    lat0 = (lat_min + lat_max) / 2 if lat0 is None else lat0
    zone = min(60, max(1, math.floor((lon0 + 180) / 6) + 1))
    centre = 6 * zone - 183
    if max(abs(lon_min - centre), abs(lon_max - centre)) <= 5:
        return utm(zone, lat0 < 0)
    if 20 < abs(lat0) < 70:
        span = lat_max - lat_min
        one, two = lat_min + span / 6, lat_max - span / 6
        if two - one < 1e-9:
            one, two = lat0 - 5, lat0 + 5
        return CRS("albers", (one, two, lat0, lon0))
    return CRS("laea", (lat0, lon0))


def _q(s):
    """Authalic function of a sine of latitude; numbers and columns alike."""
    if isinstance(s, Column):
        return (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(ECC * s) / ECC)
    return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(ECC * s) / ECC)


def forward(crs: CRS, lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees."""
    lam, phi = F.radians(lon), F.radians(lat)
    if crs.kind == "longlat":
        return lon, lat
    if crs.kind == "webmerc":
        return A * lam, A * F.log(F.tan(math.pi / 4 + phi / 2))
    if crs.kind == "utm":
        zone, south = crs.params
        n = FLAT / (2 - FLAT)
        radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        s = 2 * math.sqrt(n) / (1 + n)
        t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
        d = lam - math.radians(6 * zone - 183)
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
        y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
        return 500000 + 0.9996 * radius * x, (1e7 if south else 0) + 0.9996 * radius * y
    if crs.kind == "albers":
        one, two, lat0, lon0 = (math.radians(v) for v in crs.params)
        m = [math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2) for p in (one, two)]
        q = [_q(math.sin(p)) for p in (one, two, lat0)]
        n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0]) if abs(one - two) > 1e-12 else math.sin(one)
        c = m[0] ** 2 + n * q[0]
        rho, rho0 = A * F.sqrt(c - n * _q(F.sin(phi))) / n, A * math.sqrt(c - n * q[2]) / n
        theta = n * (lam - lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)
    if crs.kind == "laea":
        lat0, lon0 = (math.radians(v) for v in crs.params)
        qp = _q(1.0)
        beta0 = math.asin(max(-1.0, min(1.0, _q(math.sin(lat0)) / qp)))
        beta = F.asin(_q(F.sin(phi)) / qp)
        rq = A * math.sqrt(qp / 2)
        d = A * math.cos(lat0) / math.sqrt(1 - E2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
        b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(lam - lon0)))
        return b * d * F.cos(beta) * F.sin(lam - lon0), b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(lam - lon0))
    raise ValueError(f"no projection for {crs.kind}")


def _latitude(beta: Column) -> Column:
    """Latitude of an authalic latitude."""
    e2, e4, e6 = E2, E2**2, E2**3
    return beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)


def inverse(crs: CRS, x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of metres."""
    if crs.kind == "longlat":
        return x, y
    if crs.kind == "webmerc":
        return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)
    if crs.kind == "utm":
        zone, south = crs.params
        n = FLAT / (2 - FLAT)
        radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
        xi, eta = (y - (1e7 if south else 0)) / (0.9996 * radius), (x - 500000) / (0.9996 * radius)
        u = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
        v = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
        chi = F.asin(F.sin(u) / F.cosh(v))
        phi = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
        return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)
    if crs.kind == "albers":
        one, two, lat0, lon0 = (math.radians(v) for v in crs.params)
        m = [math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2) for p in (one, two)]
        q = [_q(math.sin(p)) for p in (one, two, lat0)]
        n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0]) if abs(one - two) > 1e-12 else math.sin(one)
        c = m[0] ** 2 + n * q[0]
        down, sign = A * math.sqrt(c - n * q[2]) / n - y, 1 if n > 0 else -1
        rho2 = x * x + down * down
        beta = F.asin((c - rho2 * (n / A) ** 2) / n / _q(1.0))
        return F.degrees(F.atan2(sign * x, sign * down) / n) + math.degrees(lon0), F.degrees(_latitude(beta))
    if crs.kind == "laea":
        lat0, lon0 = (math.radians(v) for v in crs.params)
        qp = _q(1.0)
        beta0 = math.asin(max(-1.0, min(1.0, _q(math.sin(lat0)) / qp)))
        rq = A * math.sqrt(qp / 2)
        d = A * math.cos(lat0) / math.sqrt(1 - E2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
        rho = F.sqrt(x / d * (x / d) + d * y * (d * y))
        ce = 2 * F.asin(rho / (2 * rq))
        beta = F.asin(F.cos(ce) * math.sin(beta0) + F.when(rho > 0, d * y * F.sin(ce) * math.cos(beta0) / rho).otherwise(0.0))
        lon = F.atan2(x * F.sin(ce), d * rho * math.cos(beta0) * F.cos(ce) - d * d * y * math.sin(beta0) * F.sin(ce))
        return F.degrees(F.when(rho > 0, lon).otherwise(0.0)) + math.degrees(lon0), F.degrees(_latitude(beta))
    raise ValueError(f"no projection for {crs.kind}")


def reproject(df: DataFrame, source: CRS, target: CRS) -> DataFrame:
    """Points from one known system to another, by way of degrees."""
    if source == target:
        return df
    lon, lat = inverse(source, F.col("x"), F.col("y"))
    x, y = forward(target, F.col("__lon"), F.col("__lat"))
    return df.withColumns({"__lon": lon, "__lat": lat}).withColumns({"x": x, "y": y}).drop("__lon", "__lat")


def project(df: DataFrame, crs: CRS) -> DataFrame:
    x, y = forward(crs, F.col("x"), F.col("y"))
    return df.withColumns({"x": x, "y": y})


def ensure_projected(df: DataFrame, crs: CRS, target: CRS | None = None) -> tuple[DataFrame, CRS]:
    """Points in a projected system.  Without a system, coordinates are taken for degrees only when they
    look like them: inside the lon/lat envelope, and wider than a degree or with fractions."""
    if target is not None:
        if crs.kind == "none":
            log.warning("no source system: the target is stamped without reprojection")
            return df, target
        if crs == target:
            return df, crs
        return reproject(df, crs, target), target
    row = None
    if crs.kind in ("none", "longlat"):
        fraction = (F.abs(F.col("x") - F.round("x")).between(0.001, 0.999)) | (F.abs(F.col("y") - F.round("y")).between(0.001, 0.999))
        row = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("x"), F.avg("y"), F.max(fraction.cast("int"))).first()
    if crs.kind == "none":
        inside = row[0] is not None and row[0] >= -180 and row[1] <= 180 and row[2] >= -90 and row[3] <= 90
        if not (inside and (row[1] - row[0] > 1 or row[3] - row[2] > 1 or row[6])):
            log.warning("no coordinate system known: coordinates are used as they are")
            return df, crs
        crs = LONGLAT
    if crs.is_longlat:
        local = pick_local(*row[:6])
        return project(df, local), local
    return df, crs


def harmonize(a: CRS, b: CRS, prefer: str = "a") -> CRS:
    """The common system of two layers: the preferred one's, or the only one known."""
    if a.kind == "none" or b.kind == "none":
        return b if a.kind == "none" else a
    return a if prefer == "a" else b


def align(df: DataFrame, crs: CRS, to: CRS) -> DataFrame:
    """Points in the system ``to`` where both systems are known and differ; else as they are."""
    return df if "none" in (crs.kind, to.kind) else reproject(df, crs, to)


def harmonize_layers(a: DataFrame, crs_a: CRS, b: DataFrame, crs_b: CRS, prefer: str = "a", target: CRS | None = None, on_transform_error: str = "stop"):
    """(a, b, system) with both layers in one system: the target, or the preferred one's.  A layer without a system
    takes the label.  Where a transformation is not known, ``"set_crs"`` relabels, else it is an error."""
    common = target or harmonize(crs_a, crs_b, prefer)
    out = []
    for df, crs in ((a, crs_a), (b, crs_b)):
        try:
            out.append(align(df, crs, common))
        except ValueError:
            if on_transform_error != "set_crs":
                raise
            log.warning("%s is relabelled as %s without a transformation", crs.kind, common.kind)
            out.append(df)
    return (*out, common)
