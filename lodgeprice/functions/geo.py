"""Great-circle distance (F7) and landmark distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, LANDMARKS
from ._col import name_or_value
from .text import column_name


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """haversine distance in km, R = 6371, ``2·asin(sqrt(a))``."""
    p1, l1 = F.radians(name_or_value(lat1)), F.radians(name_or_value(lon1))
    p2, l2 = F.radians(name_or_value(lat2)), F.radians(name_or_value(lon2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def landmark_names() -> list[str]:
    return [column_name("dist_", name, "landmark") for name, _, _ in LANDMARKS]


def landmark_distances(lat="latitude", lon="longitude") -> list[Column]:
    """One distance column per landmark, unrolled as literals (no join)."""
    return [
        haversine_km(lat, lon, F.lit(la), F.lit(lo)).alias(name)
        for name, (_, la, lo) in zip(landmark_names(), LANDMARKS)
    ]
