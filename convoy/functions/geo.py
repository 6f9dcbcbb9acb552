"""Distance, geohash and role masking as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoy.schemas import EXACT_LOCATION_ROLES

EARTH_RADIUS_KM = 6371.0
# Fixed value: the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Geohash length per role; any other role gets the coarsest.
ROLE_PRECISION = {"fleet_admin": 9, "fleet_manager": 9, "technician": 5, "auditor": 5}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geohash(lat: Column, lon: Column, precision: int = 9) -> Column:
    """Geohash of ``precision`` (1-12) characters; NULL outside the valid ranges.

    Each axis becomes one integer cell number. A character takes five alternating bits of
    the two numbers, so it is two shifts and masks plus one lookup in a 32-letter string.
    """
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(value: Column, low: float, span: float, n: int) -> Column:
        scaled = F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(1 << n)))
        return F.least(scaled.cast("bigint"), F.lit((1 << n) - 1).cast("bigint"))

    x, y = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)

    def bit(position: int) -> Column:
        axis, left = (x, lon_bits - 1 - position // 2) if position % 2 == 0 else (y, lat_bits - 1 - position // 2)
        return F.shiftright(axis, left).bitwiseAND(F.lit(1).cast("bigint"))

    chars = []
    for i in range(precision):
        index = sum((bit(5 * i + j) * F.lit(1 << (4 - j)) for j in range(5)), F.lit(0).cast("bigint"))
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (index + 1).cast("int"), F.lit(1)))
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(inside, F.concat(*chars))


def masked_location(lat: Column, lon: Column, role: Column) -> Column:
    """struct(lat, lon, geohash): exact position for admins and managers, a coarse cell otherwise."""
    exact = F.coalesce(role.isin(EXACT_LOCATION_ROLES), F.lit(False))
    coarse = min(ROLE_PRECISION.values())
    return F.struct(
        F.when(exact, lat).alias("lat"),
        F.when(exact, lon).alias("lon"),
        F.when(~exact, geohash(lat, lon, coarse)).alias("geohash"),
    )
