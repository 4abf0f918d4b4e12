"""Coordinates: great-circle distance and directions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
DIRECTIONS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points given in degrees."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def toward(direction: str, lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Whether a point lies strictly in a direction from another; the date line is not wrapped."""
    if direction not in DIRECTIONS:
        raise ValueError(f"no direction: {direction}")
    sides = {"N": lat > lat0, "S": lat < lat0, "E": lon > lon0, "W": lon < lon0}
    out = sides[direction[0]]
    return out & sides[direction[1]] if len(direction) > 1 else out
