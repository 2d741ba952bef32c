"""Geometry on structs of doubles, cubes, and distances on the earth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378168.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    """Box of two corners: struct<lo, hi> of points."""
    lo = point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]))
    return F.struct(lo.alias("lo"), point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("hi"))


def distance(a: Column, b: Column) -> Column:
    """a <-> b of points."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box_area(b: Column) -> Column:
    return (b["hi"]["x"] - b["lo"]["x"]) * (b["hi"]["y"] - b["lo"]["y"])


def box_center(b: Column) -> Column:
    return point((b["hi"]["x"] + b["lo"]["x"]) / 2, (b["hi"]["y"] + b["lo"]["y"]) / 2)


def box_overlaps(a: Column, b: Column) -> Column:
    x = (a["lo"]["x"] <= b["hi"]["x"]) & (b["lo"]["x"] <= a["hi"]["x"])
    return x & (a["lo"]["y"] <= b["hi"]["y"]) & (b["lo"]["y"] <= a["hi"]["y"])


def box_contains(a: Column, p: Column) -> Column:
    return p["x"].between(a["lo"]["x"], a["hi"]["x"]) & p["y"].between(a["lo"]["y"], a["hi"]["y"])


def box_left(a: Column, b: Column) -> Column:
    """a << b."""
    return a["hi"]["x"] < b["lo"]["x"]


def box_intersection(a: Column, b: Column) -> Column:
    """a # b; null where they do not meet."""
    lo = point(F.greatest(a["lo"]["x"], b["lo"]["x"]), F.greatest(a["lo"]["y"], b["lo"]["y"]))
    hi = point(F.least(a["hi"]["x"], b["hi"]["x"]), F.least(a["hi"]["y"], b["hi"]["y"]))
    return F.when(box_overlaps(a, b), F.struct(lo.alias("lo"), hi.alias("hi")))


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("c"), radius.cast("double").alias("r"))


def circle_area(c: Column) -> Column:
    return F.pi() * c["r"] * c["r"]


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c["c"], p) <= c["r"]


def circle_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), distance(a["c"], b["c"]) - a["r"] - b["r"])


def is_horizontal(a: Column, b: Column) -> Column:
    return a["y"] == b["y"]


def is_vertical(a: Column, b: Column) -> Column:
    return a["x"] == b["x"]


def path_length(points: Column, closed: bool = False) -> Column:
    """Length of an open or closed path (array of points)."""
    n = F.size(points)
    open_ = F.aggregate(
        F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + distance(F.get(points, i), F.get(points, i - 1))
    )
    open_ = F.when(n > 1, open_).otherwise(0.0)
    return open_ + distance(F.get(points, n - 1), F.get(points, F.lit(0))) if closed else open_


def polygon_area(points: Column) -> Column:
    """Area by the cross products of neighbouring corners."""
    n = F.size(points)
    cross = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda a, i: a + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"],
    )
    return F.abs(cross) / 2


# vectors and cubes: arrays of doubles


def euclid(a: Column, b: Column) -> Column:
    """a <-> b."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def taxicab(a: Column, b: Column) -> Column:
    """a <#> b."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)


def chebyshev(a: Column, b: Column) -> Column:
    """a <=> b."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cube_union(a: Column, b: Column) -> Column:
    """Smallest cube around two cubes: struct<lo: array, hi: array>."""
    return F.struct(F.zip_with(a["lo"], b["lo"], F.least).alias("lo"), F.zip_with(a["hi"], b["hi"], F.greatest).alias("hi"))


def cube_contains(a: Column, b: Column) -> Column:
    below = F.forall(F.zip_with(a["lo"], b["lo"], lambda x, y: x <= y), lambda v: v)
    return below & F.forall(F.zip_with(a["hi"], b["hi"], lambda x, y: x >= y), lambda v: v)


def cube_size(a: Column) -> Column:
    return F.aggregate(F.zip_with(a["lo"], a["hi"], lambda x, y: (y - x).cast("double")), F.lit(1.0), lambda s, v: s * v)


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres by the haversine form."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
