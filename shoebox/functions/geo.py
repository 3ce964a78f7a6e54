"""Points on the sphere, rings in latitude and longitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the earth in metres.
EARTH_RADIUS_M = 6371008.8


def valid_location(lat: Column, lon: Column) -> Column:
    """Both coordinates there and possible, and not the (0, 0) of a missing fix; never null."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell_of(lat: Column, lon: Column, radius_m: float) -> list[Column]:
    """Cube of the space grid with edges of ``radius_m`` that holds the point.

    A grid in space has no seam at the date line and no narrow cells at the poles: points within
    ``radius_m`` on the surface always lie in the same or in touching cubes.
    """
    r = EARTH_RADIUS_M / (radius_m * (1 + 1e-9))
    rad = [F.radians(lat), F.radians(lon)]
    xyz = [F.cos(rad[0]) * F.cos(rad[1]), F.cos(rad[0]) * F.sin(rad[1]), F.sin(rad[0])]
    return [F.floor(x * r).cast("bigint") for x in xyz]


def cell_key(cell: list[Column], radius_m: float) -> Column:
    """One number for a cube; exact while the grid has fewer than 2^21 cubes on an edge, else a hash of it."""
    if EARTH_RADIUS_M / radius_m < 2**19:
        x, y, z = (c + (1 << 20) for c in cell)
        return x * F.lit(1 << 42) + y * F.lit(1 << 21) + z
    return F.xxhash64(*cell)


def half_neighbourhood() -> list[tuple[int, int, int]]:
    """The cube itself and 13 of its 26 neighbours, so that each pair of cubes is visited from one side."""
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    return [s for s in steps if s >= (0, 0, 0)]


def unwrapped_ring(lat: list | None, lon: list | None) -> list[tuple[float, float]] | None:
    """Corners with longitudes made continuous, each edge the short way; the first corner is repeated at the end.

    A ring that runs once round a pole is closed over the pole on its side. Null for fewer than three corners,
    unequal lists or missing coordinates.
    """
    if lat is None or lon is None or len(lat) != len(lon) or any(v is None or math.isnan(v) or math.isinf(v) for v in [*lat, *lon]):
        return None
    corners = [(float(a), float(b)) for a, b in zip(lat, lon)]
    if len(corners) > 1 and corners[0] == corners[-1]:
        corners.pop()
    if len(corners) < 3:
        return None
    ring, at = [corners[0]], corners[0][1]
    for a, b in [*corners[1:], corners[0]]:
        step = (b - at + 180) % 360 - 180
        at += 180.0 if step == -180 and b > at else step
        ring.append((a, at))
    if abs(ring[-1][1] - ring[0][1]) > 180:
        pole = 90.0 if sum(a for a, _ in corners) >= 0 else -90.0
        ring += [(pole, ring[-1][1]), (pole, ring[0][1]), ring[0]]
    return ring
