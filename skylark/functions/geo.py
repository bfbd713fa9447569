"""Distances and grid cells on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylark.params import EARTH_KM


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(value: Column, step: float) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(value / step).cast("long")


def within_radius(lat: Column, lng: Column, anchors: list[tuple[float, float]], km: float = 250.0) -> Column:
    """1.0 if any anchor is within km, else 0.0, also for null coordinates and without anchors."""
    near = F.lit(False)
    for a, b in anchors:
        near = near | F.coalesce(haversine_km(lat, lng, F.lit(a), F.lit(b)) <= km, F.lit(False))
    return near.cast("double")
