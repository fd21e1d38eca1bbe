"""Distances, conversions and pixel arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    return F.lit(2.0 * radius) * F.asin(F.sqrt(_haversine_term(lat1, lon1, lat2, lon2)))


def haversine_atan(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6367.0) -> Column:
    """Same distance by the two-argument arctangent; takes longitudes first."""
    a = _haversine_term(lat1, lon1, lat2, lon2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def _haversine_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    half_lat, half_lon = F.sin(dlat / 2), F.sin(dlon / 2)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon


def straight_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance in the unit of the coordinates (degrees here)."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def km_to_degrees(km: Column | float) -> Column:
    return (km if isinstance(km, Column) else F.lit(float(km))) / F.lit(KM_PER_DEGREE)


def km_to_degrees_averaged(km: Column, latitude: float = 1.3) -> Column:
    """Mean of the latitude and longitude conversions at a fixed latitude."""
    along_lat = km / F.lit(KM_PER_DEGREE)
    along_lon = km / F.lit(KM_PER_DEGREE * math.cos(math.radians(latitude)))
    return (along_lat + along_lon) / 2


def cell_index(value: Column, origin: float | Column, resolution: float, downward: bool = False) -> Column:
    """Grid index of a coordinate; ``downward`` counts from a top origin."""
    start = origin if isinstance(origin, Column) else F.lit(float(origin))
    distance = (start - value) if downward else (value - start)
    return F.floor(distance / F.lit(float(resolution))).cast("long")


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment (round caps)."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((px - ax) * dx + (py - ay) * dy) / squared).otherwise(F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return straight_distance(px, py, ax + along * dx, ay + along * dy)
