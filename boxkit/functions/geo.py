"""Positions on the ground and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude.
DEGREE = 111320.0


def nmea_degrees(value: Column) -> Column:
    """ddmm.mmmm to degrees, the sign kept."""
    v = F.abs(value)
    deg = F.floor(v / 100)
    return F.signum(value) * (deg + (v - deg * 100) / 60)


def east_north(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference position."""
    return (lon - lon0) * DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE


def footprint(e: Column, n: Column, heading: Column, wide: Column, long: Column) -> list[tuple[Column, Column]]:
    """Corners of a ground rectangle about (e, n), long side along the heading in degrees."""
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    out = []
    for dx, dy in ((-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5)):
        x, y = wide * dx, long * dy
        out.append((e + x * c + y * s, n - x * s + y * c))
    return out


def polygon_area(xs: Column, ys: Column) -> Column:
    """The shoelace area of a polygon given as two arrays."""
    n = F.size(xs)
    turned = lambda a: F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, 1))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.abs(add(F.zip_with(xs, turned(ys), lambda x, y: x * y)) - add(F.zip_with(ys, turned(xs), lambda y, x: x * y))) / 2


def rle_area(counts: Column) -> Column:
    """Set pixels of a run-length mask: every second count."""
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)
