"""Closed-form coordinate transforms as column expressions.

Conic, spherical-Mercator and transverse-Mercator formulas on the GRS80 / WGS84 ellipsoid; a
transform is a projection over whole tables and adds no stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid and projection parameters.
AXIS_M = 6378137.0
FLATTENING = 1.0 / 298.257222101
CONIC = {"lat1": 44.0, "lat2": 49.0, "lat0": 46.5, "lon0": 3.0, "x0": 700000.0, "y0": 6600000.0}
UTM = {"k0": 0.9996, "x0": 500000.0, "lon0": 3.0}

ECC = math.sqrt(FLATTENING * (2.0 - FLATTENING))


def _isometric(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.atanh(math.sin(lat)) - ECC * math.atanh(s)


def _conic_constants() -> tuple[float, float, float]:
    def m(lat: float) -> float:
        return math.cos(lat) / math.sqrt(1.0 - (ECC * math.sin(lat)) ** 2)

    lat1, lat2, lat0 = (math.radians(CONIC[k]) for k in ("lat1", "lat2", "lat0"))
    n = math.log(m(lat1) / m(lat2)) / (_isometric(lat2) - _isometric(lat1))
    c = AXIS_M * m(lat1) / n * math.exp(n * _isometric(lat1))
    return n, c, CONIC["y0"] + c * math.exp(-n * _isometric(lat0))


CONIC_N, CONIC_C, CONIC_YS = _conic_constants()


def _latitude_series() -> tuple[float, float, float, float]:
    """Coefficients giving geographic from conformal latitude."""
    e2 = ECC**2
    return (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )


LATITUDE_SERIES = _latitude_series()


def _isometric_column(lat: Column) -> Column:
    s = F.sin(lat)
    return F.atanh(s) - F.lit(ECC) * F.atanh(F.lit(ECC) * s)


def _latitude_from_conformal(chi: Column) -> Column:
    out = chi
    for k, coefficient in enumerate(LATITUDE_SERIES, start=1):
        out = out + F.lit(coefficient) * F.sin(chi * F.lit(2.0 * k))
    return out


def wgs84_to_l93(lon: Column, lat: Column) -> tuple[Column, Column]:
    radius = F.lit(CONIC_C) * F.exp(-F.lit(CONIC_N) * _isometric_column(F.radians(lat)))
    gamma = F.lit(CONIC_N) * F.radians(lon - F.lit(CONIC["lon0"]))
    return F.lit(CONIC["x0"]) + radius * F.sin(gamma), F.lit(CONIC_YS) - radius * F.cos(gamma)


def l93_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = x - F.lit(CONIC["x0"]), F.lit(CONIC_YS) - y
    lon = F.lit(CONIC["lon0"]) + F.degrees(F.atan2(dx, dy)) / F.lit(CONIC_N)
    iso = -F.log(F.sqrt(dx * dx + dy * dy) / F.lit(CONIC_C)) / F.lit(CONIC_N)
    chi = F.lit(2.0) * F.atan(F.exp(iso)) - F.lit(math.pi / 2)
    return lon, F.degrees(_latitude_from_conformal(chi))


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.lit(2.0) * F.atan(F.exp(y / F.lit(AXIS_M))) - F.lit(math.pi / 2)
    return F.degrees(x / F.lit(AXIS_M)), F.degrees(lat)


def wgs84_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.lit(AXIS_M), F.lit(AXIS_M) * F.atanh(F.sin(F.radians(lat)))


def mercator_to_l93(x: Column, y: Column) -> tuple[Column, Column]:
    return wgs84_to_l93(*mercator_to_wgs84(x, y))


def _transverse_series() -> tuple[float, tuple[float, ...], tuple[float, ...]]:
    n = FLATTENING / (2.0 - FLATTENING)
    radius = AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    backward = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    return radius, forward, backward


TM_RADIUS, TM_FORWARD, TM_BACKWARD = _transverse_series()


def wgs84_to_utm31(lon: Column, lat: Column) -> tuple[Column, Column]:
    t = F.sinh(_isometric_column(F.radians(lat)))
    dlon = F.radians(lon - F.lit(UTM["lon0"]))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    north, east = xi, eta
    for j, a in enumerate(TM_FORWARD, start=1):
        k = F.lit(2.0 * j)
        north = north + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
        east = east + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
    scale = F.lit(UTM["k0"] * TM_RADIUS)
    return F.lit(UTM["x0"]) + scale * east, scale * north


def utm31_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    scale = F.lit(UTM["k0"] * TM_RADIUS)
    xi, eta = y / scale, (x - F.lit(UTM["x0"])) / scale
    north, east = xi, eta
    for j, b in enumerate(TM_BACKWARD, start=1):
        k = F.lit(2.0 * j)
        north = north - F.lit(b) * F.sin(k * xi) * F.cosh(k * eta)
        east = east - F.lit(b) * F.cos(k * xi) * F.sinh(k * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lon = F.lit(UTM["lon0"]) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    return lon, F.degrees(_latitude_from_conformal(chi))


def reproject_bbox(minx: Column, miny: Column, maxx: Column, maxy: Column, transform) -> dict[str, Column]:
    """Envelope of the four reprojected corners."""
    corners = [transform(x, y) for x in (minx, maxx) for y in (miny, maxy)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {
        "minx": F.least(*xs),
        "miny": F.least(*ys),
        "maxx": F.greatest(*xs),
        "maxy": F.greatest(*ys),
    }
