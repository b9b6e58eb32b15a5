"""Distances, grids, hexagons and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32
#: Latitude at which the local projection is true.
LATITUDE = 43.25


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def project_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in km on a plane that fits the city."""
    return lon * (KM_PER_DEGREE * math.cos(math.radians(LATITUDE))), lat * KM_PER_DEGREE


def plane_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the plane at the mean latitude."""
    x = (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, (lat2 - lat1) * KM_PER_DEGREE)


def hex_cell(lat: Column, lon: Column, size_km: float) -> Column:
    """The axial coordinates 'q:r' of the pointy-top hexagon (side ``size_km``) that holds the point."""
    x, y = project_km(lat, lon)
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size_km, (2 / 3 * y) / size_km
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fixed_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fixed_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(":", fixed_q.cast("long"), fixed_r.cast("long")))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against a ring (array of struct lat, lon; closed by itself): crossings of a ray to greater longitude."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = F.filter(
        edges,
        lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (e["a"]["lon"] + (lat - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"]) / (e["b"]["lat"] - e["a"]["lat"]) > lon),
    )
    return F.size(crosses) % 2 == 1


def in_polygon(lat: Column, lon: Column, outer: Column, inner: Column) -> Column:
    """In one of the outer rings and in none of the inner ones."""
    return F.exists(outer, lambda r: in_ring(lat, lon, r)) & ~F.exists(inner, lambda r: in_ring(lat, lon, r))


def walk_score(distances: dict[str, tuple[Column, float]]) -> Column:
    """Sum of max(0, 1 - (d / cap)^2) over six kinds of places, in per cent of six; null if all are missing."""
    parts = [F.coalesce(F.greatest(F.lit(0.0), 1 - F.pow(d / cap, 2)), F.lit(0.0)) for d, cap in distances.values()]
    some = F.coalesce(*(d for d, _ in distances.values())).isNotNull()
    return F.when(some, F.round(sum(parts, F.lit(0.0)) / 6 * 100, 1))
