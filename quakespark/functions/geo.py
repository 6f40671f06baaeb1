"""Distances, boxes and cells on the sphere, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii of the Earth in km: for events, and for the population grid.
EVENT_RADIUS_KM, PIXEL_RADIUS_KM = 6371.0, 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EVENT_RADIUS_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def circle_bounds(lat: Column, lon: Column, radius_km: float) -> dict[str, Column]:
    """A circle's box in degrees; the cosine has a floor, so boxes at the poles are wide but finite."""
    high = F.lit(radius_km / 111.0)
    wide = F.lit(radius_km) / (F.lit(111.0) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return {"lat_min": lat - high, "lat_max": lat + high, "lon_min": lon - wide, "lon_max": lon + wide}


def cell_ranges(lat: Column, lon: Column, radius_km: float, degrees: float) -> tuple[Column, Column, Column, Column]:
    """Of a grid of ``degrees`` the first and last row, and first and last column, that a circle may touch; columns count on across the date line."""
    around = round(360 / degrees)
    angle = radius_km / EVENT_RADIUS_KM * 1.001
    high = math.degrees(angle)
    ratio = F.lit(math.sin(min(angle, math.pi / 2))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    polar = (F.abs(lat) + high >= 90) | (ratio >= 1)
    wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-6)
    first = F.floor((lon - wide) / degrees).cast("int")
    last = F.least(F.floor((lon + wide) / degrees).cast("int"), first + around - 1)
    return F.floor((lat - high) / degrees).cast("int"), F.floor((lat + high) / degrees).cast("int"), first, last


def cells_around(lat: Column, lon: Column, radius_km: float, degrees: float) -> Column:
    """The cells (struct y, x) of a grid of ``degrees`` that a circle may touch, across the date line and the poles."""
    low, high, first, last = cell_ranges(lat, lon, radius_km, degrees)
    columns = F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.lit(round(360 / degrees))))
    return F.flatten(F.transform(F.sequence(low, high), lambda y: F.transform(columns, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    around = round(360 / degrees)
    return F.floor(lat / degrees).cast("int"), F.pmod(F.floor(lon / degrees).cast("int"), F.lit(around))


def half_planes(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """The half-planes that hold a point: West or East, and South or North, of the mainshock."""
    return F.array(F.when(lon < lon0, "West_of_ms").otherwise("East_of_ms"), F.when(lat < lat0, "South_of_ms").otherwise("North_of_ms"))
