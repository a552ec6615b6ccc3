"""Great-circle distance and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_RADIUS_KM
) -> Column:
    """Great-circle distance in km between two points given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = (phi2 - phi1) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(phi1) * F.cos(phi2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))))


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Struct (lat_cell, lon_cell) of the degree grid; negatives floor down."""
    return F.struct(
        F.floor(lat / F.lit(float(degrees))).cast("int").alias("lat_cell"),
        F.floor(lon / F.lit(float(degrees))).cast("int").alias("lon_cell"),
    )


def valid_position(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
