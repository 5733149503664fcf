"""Distances on the WGS84 spheroid and the grid that keeps radius joins local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points by Lambert's formula for long lines on the spheroid: the central
    angle on reduced latitudes, corrected for the flattening. Null when any part is.

    No branch anywhere: generated code then evaluates each repeated part once. The tiny floor under
    the denominators only ever divides a zero."""
    b1 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat1)))
    b2 = F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat2)))
    square = lambda c: c * c
    mid, diff = (b1 + b2) / 2, (b2 - b1) / 2
    half = square(F.sin(diff)) + F.cos(b1) * F.cos(b2) * square(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2))  # the squared sine of half the angle
    angle = 2 * F.asin(F.least(F.sqrt(half), F.lit(1.0)))
    tiny = F.lit(1e-300)
    x = (angle - F.sin(angle)) * square(F.sin(mid) * F.cos(diff)) / F.greatest(1 - half, tiny)
    y = (angle + F.sin(angle)) * square(F.cos(mid) * F.sin(diff)) / F.greatest(half, tiny)
    known = lat1 + lon1 + lat2 + lon2  # null when any of them is; `greatest` and `least` skip nulls
    return F.lit(SEMI_MAJOR_M) * (angle - F.lit(FLATTENING / 2) * (x + y)) + known * 0


def distance_km(metres: Column) -> Column:
    """Kilometres to 100 m, halves away from zero."""
    return F.round((metres / 1000).cast("decimal(20,10)"), 1).cast("double")


# A degree of latitude is at least 110.5 km everywhere on the spheroid.
_METRES_PER_DEGREE = 110_500.0


def lat_reach(radius_m: Column) -> Column:
    """Degrees of latitude that certainly hold everything within `radius_m`."""
    return radius_m / _METRES_PER_DEGREE + F.lit(1e-6)


def lon_reach(lat: Column, radius_m: Column) -> Column:
    """Degrees of longitude that certainly hold everything within `radius_m` of a point."""
    edge = F.abs(lat) + lat_reach(radius_m)
    return F.when(edge < 89.0, radius_m / (_METRES_PER_DEGREE * F.cos(F.radians(edge))) + 1e-6
                  ).otherwise(F.lit(360.0))
