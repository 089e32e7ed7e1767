"""Predicates and arithmetic of boxes: structs of minx, miny, maxx, maxy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("minx", "miny", "maxx", "maxy")


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A box of two corners, whichever way round."""
    return F.struct(F.least(minx, maxx).alias("minx"), F.least(miny, maxy).alias("miny"), F.greatest(minx, maxx).alias("maxx"), F.greatest(miny, maxy).alias("maxy"))


def width(b: Column) -> Column:
    return b["maxx"] - b["minx"]


def height(b: Column) -> Column:
    return b["maxy"] - b["miny"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["minx"], b["maxx"]) & y.between(b["miny"], b["maxy"])


def equal(a: Column, b: Column) -> Column:
    return (a["minx"] == b["minx"]) & (a["miny"] == b["miny"]) & (a["maxx"] == b["maxx"]) & (a["maxy"] == b["maxy"])


def intersects(a: Column, b: Column) -> Column:
    """Closed: boxes that touch intersect."""
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def overlaps_strictly(a: Column, b: Column) -> Column:
    return (a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"])


def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def contains(a: Column, b: Column) -> Column:
    return (b["minx"] >= a["minx"]) & (b["maxx"] <= a["maxx"]) & (b["miny"] >= a["miny"]) & (b["maxy"] <= a["maxy"])


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def touches_compat(a: Column, b: Column) -> Column:
    """Any edge at the same place as the same edge of the other box."""
    return (a["minx"] == b["minx"]) | (a["miny"] == b["miny"]) | (a["maxx"] == b["maxx"]) | (a["maxy"] == b["maxy"])


def touches(a: Column, b: Column) -> Column:
    """Boundaries meet but interiors do not."""
    return intersects(a, b) & ~overlaps_strictly(a, b)


def overlaps(a: Column, b: Column) -> Column:
    """Not disjoint, and some edge of a lies within b's range."""
    inside = lambda v, lo, hi: a[v].between(b[lo], b[hi])
    return intersects(a, b) & (inside("minx", "minx", "maxx") | inside("maxx", "minx", "maxx") | inside("miny", "miny", "maxy") | inside("maxy", "miny", "maxy"))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["minx"], b["minx"]).alias("minx"), F.least(a["miny"], b["miny"]).alias("miny"), F.greatest(a["maxx"], b["maxx"]).alias("maxx"), F.greatest(a["maxy"], b["maxy"]).alias("maxy"))


def clip(a: Column, b: Column) -> Column:
    """The common part of two boxes, null if they don't overlap."""
    common = F.struct(F.greatest(a["minx"], b["minx"]).alias("minx"), F.greatest(a["miny"], b["miny"]).alias("miny"), F.least(a["maxx"], b["maxx"]).alias("maxx"), F.least(a["maxy"], b["maxy"]).alias("maxy"))
    return F.when(overlaps_strictly(a, b), common)


def scale(b: Column, s: float) -> Column:
    return F.struct(*[(b[e] * s).alias(e) for e in EDGES])
