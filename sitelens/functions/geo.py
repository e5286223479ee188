"""Great-circle distance and unit-sphere geometry as native Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: IUGG mean Earth radius in km and
# the number of decimals kept on exported distances.
EARTH_RADIUS_KM = 6371.0088
DISTANCE_DECIMALS = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Clamped arcsine haversine; stays inside whole-stage codegen."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlam = F.radians(_c(lon2)) - F.radians(_c(lon1))
    s1, s2 = F.sin(dphi / 2), F.sin(dlam / 2)
    h = s1 * s1 + F.cos(p1) * F.cos(p2) * (s2 * s2)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2.0) * F.asin(F.sqrt(h)))


def haversine_atan2_km(lat1, lon1, lat2, lon2) -> Column:
    """atan2 form used by the duplicate check; same value to far below 1e-6 km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlam = F.radians(_c(lon2) - _c(lon1))
    s1, s2 = F.sin(dphi / 2), F.sin(dlam / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * (s2 * s2)
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def rounded_km(distance: Column) -> Column:
    """``distance`` (on the Earth) rounded half up by its decimal text, as ``round`` does it. The text decides only near
    halves: elsewhere the nearest number of the last decimal is the same and far cheaper."""
    scale = F.lit(10.0 ** DISTANCE_DECIMALS)
    scaled = distance * scale
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) < 0.499, whole / scale).otherwise(F.round(distance, DISTANCE_DECIMALS))


def unit_vector(lat, lon) -> list[Column]:
    """(x, y, z) of the point on the unit sphere."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def chord_for_km(radius_km: float) -> float:
    """Straight-line distance on the unit sphere for a great-circle distance."""
    angle = min(max(radius_km, 0.0) / EARTH_RADIUS_KM, math.pi)
    return 2.0 * math.sin(angle / 2.0)


def grid_cell_width(radius_km: float) -> float:
    """Cell width such that any pair within ``radius_km`` lies in adjacent cells.

    A small relative and absolute margin keeps floating error from losing a
    boundary pair; a zero radius still gets a positive width.
    """
    return chord_for_km(radius_km) * (1.0 + 1e-9) + 1e-12


def coordinate_text(col) -> Column:
    """A coordinate as export text: 15 significant digits, no zeros at the end."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.format_string("%.15g", c.cast("double"))
    text = F.regexp_replace(text, r"(\.\d*?)0+(?=$|e)", "$1")
    return F.when(c.isNotNull(), F.regexp_replace(text, r"\.(?=$|e)", ""))


MORTON_BITS = 21


def morton_key(lat, lon) -> Column:
    """Place on the Z-order curve through the cube around the sphere: points close on the curve are close on
    the sphere. NULL without coordinates."""
    # (shift, mask) steps that leave two free bits after each of 21 bits
    steps = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3),
             (2, 0x1249249249249249))
    table = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(m).alias("mask")) for s, m in steps])
    top = (1 << MORTON_BITS) - 1
    key = F.lit(0).cast("bigint")
    for axis, v in enumerate(unit_vector(lat, lon)):
        cell = F.least(F.lit(top), F.greatest(F.lit(0), F.floor((v + 1.0) / 2.0 * top))).cast("bigint")
        spread = F.aggregate(table, cell, lambda x, s: x.bitwiseOR(
            F.call_function("shiftleft", x, s["shift"])).bitwiseAND(s["mask"]))
        key = key.bitwiseOR(F.shiftleft(spread, axis))
    return F.when(_c(lat).isNotNull() & _c(lon).isNotNull(), key)
