"""Great-circle helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col

# Fixed value: mean earth radius in miles.
EARTH_RADIUS_MILES = 3958.7613


def haversine_miles(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    s1 = F.sin((c - a) / 2)
    s2 = F.sin((d - b) / 2)
    h = s1 * s1 + F.cos(a) * F.cos(c) * s2 * s2
    return F.lit(2.0 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def unit_vector(lat: Column | str, lon: Column | str) -> tuple[Column, Column, Column]:
    """Position on the sphere of earth radius, in miles; straight-line distance orders like great-circle distance."""
    phi, lam = F.radians(col(lat)), F.radians(col(lon))
    r = F.lit(EARTH_RADIUS_MILES)
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


def chord_miles(arc_miles: float) -> float:
    """Straight-line length under a great-circle arc (arcs beyond half the globe give the diameter)."""
    half_angle = min(arc_miles / EARTH_RADIUS_MILES, math.pi) / 2
    return 2 * EARTH_RADIUS_MILES * math.sin(half_angle)


def in_coverage(lat: Column | str, lon: Column | str) -> Column:
    """Usable branch coordinates, bounds inclusive (fixed values)."""
    return col(lat).between(17.0, 72.0) & col(lon).between(-180.0, -65.0)


def in_map_view(lat: Column | str, lon: Column | str) -> Column:
    """Looser bounds used for drawing, exclusive (fixed values)."""
    la, lo = col(lat), col(lon)
    return (la > 14.0) & (la < 72.0) & (lo > -180.0) & (lo < -50.0)
