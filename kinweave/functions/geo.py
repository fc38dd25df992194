"""Coordinates: distance, projection and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Fixed value: the latitude at which the map ends.
MERCATOR_EDGE = 85.0511


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_x(lon: Column, zoom: int) -> Column:
    return (lon + 180) / 360 * (256 * 2**zoom)


def mercator_y(lat: Column, zoom: int) -> Column:
    s = F.sin(F.radians(F.greatest(F.lit(-MERCATOR_EDGE), F.least(F.lit(MERCATOR_EDGE), lat))))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * (256 * 2**zoom)


def parse_coord(text: Column) -> Column:
    """Signed degrees of ``N46.05``, ``46.05 S``, ``-14.5`` or ``46°3'0"N``; null if it is none."""
    t = F.upper(F.trim(text))
    sign = F.when(t.rlike("[SW]") | t.startswith("-"), -1.0).otherwise(1.0)
    bare = F.regexp_replace(t, r"[NSEW\s-]", "")
    dms = r"^(\d+(?:\.\d+)?)°(?:(\d+(?:\.\d+)?)')?(?:(\d+(?:\.\d+)?)\")?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(bare, dms, i).try_cast("double"), F.lit(0.0))

    return (
        F.when(bare.rlike(r"^\d+(\.\d+)?$"), sign * bare.try_cast("double"))
        .when(bare.rlike(dms), sign * (part(1) + part(2) / 60 + part(3) / 3600))
    )
