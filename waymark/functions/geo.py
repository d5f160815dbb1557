"""Planar distances and search boxes in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM, EQUATOR_KM = 6371.0, 40030.0


def planar_km(lat: Column, lon: Column, at_lat, at_lon) -> Column:
    """Distance on the flat map of degrees; meridians do not converge, the date line is not crossed."""
    dy, dx = lat.cast("double") - at_lat, lon.cast("double") - at_lon
    return (F.sqrt(dy * dy + dx * dx) / 360.0 * EQUATOR_KM).cast("float")


def reach_degrees(km: float) -> float:
    """Farthest that planar_km can put a point of this distance away in one coordinate."""
    return km / EQUATOR_KM * 360.0


def box_half_widths(km: float, latitude: float) -> tuple[float, float]:
    """Half widths (latitude, longitude) of a circle's box on the sphere; NaN where it holds a pole."""
    lat = km / (2 * math.pi * EARTH_RADIUS_KM) * 360
    x = math.sin(km / EARTH_RADIUS_KM) / math.cos(math.radians(latitude))
    return lat, math.degrees(math.asin(x)) if abs(x) <= 1 else float("nan")


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b)
