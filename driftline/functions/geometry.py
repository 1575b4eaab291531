"""Distances, predicates and small mathematics, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import let

EARTH_M = 6378137.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """FN-12: metres on a sphere of EARTH_M."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return let(a, lambda x: F.lit(2 * EARTH_M) * F.atan2(F.sqrt(x), F.sqrt(1 - x)))


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """FN-13."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def segment_meets_rect(x1: Column, y1: Column, x2: Column, y2: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """FN-22: the segment's box overlaps, and the rectangle's corners are not all on one side of its line."""
    shadow = (F.greatest(x1, x2) >= min_x) & (F.least(x1, x2) <= max_x) & (F.greatest(y1, y2) >= min_y) & (F.least(y1, y2) <= max_y)
    sides = [F.signum((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) for x, y in ((min_x, min_y), (min_x, max_y), (max_x, min_y), (max_x, max_y))]
    return shadow & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def rects_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """FN-23: borders count."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def rect_holds_point(r: dict[str, Column], x: Column, y: Column) -> Column:
    """FN-24: borders do not count."""
    return (x > r["min_x"]) & (x < r["max_x"]) & (y > r["min_y"]) & (y < r["max_y"])


def box_holds_point(r: dict[str, Column], x: Column, y: Column) -> Column:
    """FN-25/26: lower borders count, upper do not."""
    return (x >= r["min_x"]) & (x < r["max_x"]) & (y >= r["min_y"]) & (y < r["max_y"])


def cap_holds(lat: Column, lon: Column, center_lat: float, center_lon: float, angle_degrees: float) -> Column:
    """GEO-6: within an angle of an axis, by the dot product of unit vectors."""
    p, a = math.radians(center_lat), math.radians(center_lon)
    x, y, z = math.cos(p) * math.cos(a), math.cos(p) * math.sin(a), math.sin(p)
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo) * x + F.cos(la) * F.sin(lo) * y + F.sin(la) * z >= math.cos(math.radians(angle_degrees))


def interval_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """GEO-5."""
    return (lo1 <= hi2) & (lo2 <= hi1)


def normal_pdf(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """FN-29."""
    return F.exp(-(x - mean) * (x - mean) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, step: float = 0.01, start: float = -10.0) -> Column:
    """FN-29: rectangle rule from ``start`` (below which the mass is under 1e-22)."""
    n = F.greatest(F.floor((x - start) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + normal_pdf(F.lit(start) + k * step) * step)).otherwise(F.lit(0.0))


def uniform(seed: int) -> Column:
    """FN-28."""
    return F.rand(seed)


def gaussian(seed: int) -> Column:
    return F.randn(seed)


def cauchy(seed: int) -> Column:
    return F.tan((F.rand(seed) - 0.5) * math.pi)


def lsh_coefficients(dims: int, functions: int, seed: int, w: float = 1.0, t: float = 1.0, c: float = 2.0) -> list[tuple[int, list[float], float]]:
    """IDX-22: (function, a, b) with a ~ N(0, 1) and b uniform below c^floor(log_c(t d)) w^2. A model: small, made on the driver."""
    import random

    r = random.Random(seed)
    most = c ** math.floor(math.log(max(t * dims, 1.0), c)) * w * w
    return [(f, [r.gauss(0, 1) for _ in range(dims)], r.uniform(0, most)) for f in range(functions)]


def dot(a: Column, b: Column) -> Column:
    """UTL-9."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    """FN-31."""
    return F.zip_with(a, b, lambda x, y: x + y)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """UTL-8."""
    return F.least(F.greatest(x, low), high)


def gcd(a: Column, b: Column) -> Column:
    """UTL-8: by a bounded Euclid; longs need at most 92 steps."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).cast("long").alias("b"))))["a"]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
