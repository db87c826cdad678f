"""Box columns: x1, y1, x2, y2 with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(prefix: str = "") -> list[str]:
    return [f"{prefix}{k}" for k in ("x1", "y1", "x2", "y2")]


def width(p: str = "") -> Column:
    return F.col(f"{p}x2") - F.col(f"{p}x1")


def height(p: str = "") -> Column:
    return F.col(f"{p}y2") - F.col(f"{p}y1")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def centre(p: str = "") -> tuple[Column, Column]:
    return (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2, (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where the union has no area."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def distance(a: str, b: str) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def scaled(factor: float) -> list[Column]:
    """The box scaled about its centre."""
    (cx, cy), w, h = centre(), width() * factor / 2, height() * factor / 2
    return [(cx - w).alias("x1"), (cy - h).alias("y1"), (cx + w).alias("x2"), (cy + h).alias("y2")]


def prefixed(df, prefix: str, keys: list[str]):
    """All columns but the keys with a prefix."""
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))
