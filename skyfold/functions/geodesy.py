"""WGS-84 conversions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skyfold.functions.linalg import Vec, clip

# WGS-84 ellipsoid and transverse Mercator scale.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1.0 - FLATTENING)
ECC2 = 2.0 * FLATTENING - FLATTENING**2
ECC2_SECOND = (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2
UTM_K0 = 0.9996
MERCATOR_MAX_LAT = 85.051128


def prime_vertical(sin_lat: Column) -> Column:
    return F.lit(SEMI_MAJOR) / F.sqrt(1.0 - ECC2 * sin_lat * sin_lat)


def to_ecef(lat: Column, lon: Column, alt: Column) -> Vec:
    p, l = F.radians(lat), F.radians(lon)
    n = prime_vertical(F.sin(p))
    return (
        (n + alt) * F.cos(p) * F.cos(l),
        (n + alt) * F.cos(p) * F.sin(l),
        (n * (1.0 - ECC2) + alt) * F.sin(p),
    )


def from_ecef(x: Column, y: Column, z: Column) -> Vec:
    """(lat, lon, alt); the polar axis is its own case."""
    axis = F.sqrt(x * x + y * y)
    theta = F.atan2(z * SEMI_MAJOR, axis * SEMI_MINOR)
    lat = F.atan2(
        z + ECC2_SECOND * SEMI_MINOR * F.pow(F.sin(theta), F.lit(3.0)),
        axis - ECC2 * SEMI_MAJOR * F.pow(F.cos(theta), F.lit(3.0)),
    )
    alt = axis / F.cos(lat) - prime_vertical(F.sin(lat))
    polar = axis < 1e-6
    return (
        F.when(polar, F.when(z > 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(lat)),
        F.when(polar, 0.0).otherwise(F.degrees(F.atan2(y, x))),
        F.when(polar, F.abs(z) - SEMI_MINOR).otherwise(alt),
    )


def _enu_axes(lat0: Column, lon0: Column) -> tuple[Vec, Vec, Vec]:
    p, l = F.radians(lat0), F.radians(lon0)
    sp, cp, sl, cl = F.sin(p), F.cos(p), F.sin(l), F.cos(l)
    return (-sl, cl, F.lit(0.0)), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp)


def to_enu(lat, lon, alt, lat0, lon0, alt0) -> Vec:
    p, o = to_ecef(lat, lon, alt), to_ecef(lat0, lon0, alt0)
    d = tuple(a - b for a, b in zip(p, o))
    return tuple(r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in _enu_axes(lat0, lon0))


def enu_to_ecef(e, n, u, lat0, lon0, alt0) -> Vec:
    east, north, up = _enu_axes(lat0, lon0)
    o = to_ecef(lat0, lon0, alt0)
    return tuple(o[i] + east[i] * e + north[i] * n + up[i] * u for i in range(3))


def from_enu(e, n, u, lat0, lon0, alt0) -> Vec:
    return from_ecef(*enu_to_ecef(e, n, u, lat0, lon0, alt0))


def to_utm(lat: Column, lon: Column) -> dict[str, Column]:
    zone = (F.floor((lon + 180.0) / 6.0) + 1).cast("int")
    phi = F.radians(lat)
    a = F.cos(phi) * (F.radians(lon) - F.radians((zone - 1) * 6.0 - 177.0))
    e4, e6 = ECC2**2, ECC2**3
    ep2 = ECC2 / (1.0 - ECC2)
    n = prime_vertical(F.sin(phi))
    t = F.tan(phi) * F.tan(phi)
    c = ep2 * F.cos(phi) * F.cos(phi)
    arc = SEMI_MAJOR * (
        (1.0 - ECC2 / 4.0 - 3.0 * e4 / 64.0 - 5.0 * e6 / 256.0) * phi
        - (3.0 * ECC2 / 8.0 + 3.0 * e4 / 32.0 + 45.0 * e6 / 1024.0) * F.sin(2.0 * phi)
        + (15.0 * e4 / 256.0 + 45.0 * e6 / 1024.0) * F.sin(4.0 * phi)
        - (35.0 * e6 / 3072.0) * F.sin(6.0 * phi)
    )

    def pw(k: int) -> Column:
        return F.pow(a, F.lit(float(k)))

    easting = 500000.0 + UTM_K0 * n * (
        a
        + (1.0 - t + c) * pw(3) / 6.0
        + (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * ep2) * pw(5) / 120.0
    )
    northing = UTM_K0 * (
        arc
        + n * F.tan(phi) * (
            pw(2) / 2.0
            + (5.0 - t + 9.0 * c + 4.0 * c * c) * pw(4) / 24.0
            + (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * ep2) * pw(6) / 720.0
        )
    )
    south = lat < 0
    return {
        "easting": easting,
        "northing": F.when(south, northing + 10000000.0).otherwise(northing),
        "zone": zone,
        "hemisphere": F.when(south, "S").otherwise("N"),
    }


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    phi = F.radians(clip(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return (
        SEMI_MAJOR * F.radians(lon),
        SEMI_MAJOR * F.log(F.tan(math.pi / 4.0 + phi / 2.0)),
    )
