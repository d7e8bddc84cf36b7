"""Geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_pixel(lat: Column, lon: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    """Pixel of a place on a web map; latitudes beyond its edge are moved to it."""
    n = float(tile * 2**zoom)
    y = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    s = F.radians(y)
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(s) + 1 / F.cos(s)) / math.pi) / 2 * n


# The European equal-area projection on its ellipsoid.
LAEA_A, LAEA_F, LAEA_LAT, LAEA_LON, LAEA_X, LAEA_Y = 6378137.0, 1 / 298.257222101, 52.0, 10.0, 4321000.0, 3210000.0


def laea(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of the European equal-area projection."""
    e2 = LAEA_F * (2 - LAEA_F)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    q_pole, p0 = q_of(1.0), math.radians(LAEA_LAT)
    b0 = math.asin(q_of(math.sin(p0)) / q_pole)
    r = LAEA_A * math.sqrt(q_pole / 2)
    d = LAEA_A * math.cos(p0) / math.sqrt(1 - e2 * math.sin(p0) ** 2) / (r * math.cos(b0))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    b, o = F.asin(q / q_pole), F.radians(lon - LAEA_LON)
    k = F.lit(r) * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(o)))
    return LAEA_X + k * d * F.cos(b) * F.sin(o), LAEA_Y + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(o))
