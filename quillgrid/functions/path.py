"""Measures, predicates and transforms of paths, in JVM-side higher-order functions.

A path is an array of structs of x and y (doubles); a ring is a path whose last point joins the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it. Within a lambda Spark computes what is named anew each time."""
    return F.transform(F.array(value), f)[0]


def of_flat(values: Column) -> Column:
    """[x0, y0, x1, y1, ...] -> path; an odd value at the end is an error of the caller's and ignored."""

    def pairs(vs: Column) -> Column:
        n = F.floor(F.size(vs) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(F.get(vs, (i * 2).cast("int")), F.get(vs, (i * 2 + 1).cast("int"))))).otherwise(F.slice(F.transform(vs, lambda v: point(v, v)), 1, 0))

    return let(values, pairs)


def of_points(*points: Column) -> Column:
    """The path of these points, in order; what they hold but x and y goes."""
    return F.array(*[point(p["x"], p["y"]) for p in points])


#: Items that one list of a running sum holds: an array that grows is copied at every step.
_RUN = 256


def running(values: Column) -> Column:
    """0, and the sum of an array's values up to each; the work is linear but for the number of runs of _RUN values."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / _RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * _RUN + 1, _RUN))
    none = F.lit(None).cast("array<double>")

    def one(acc: Column, v: Column) -> Column:
        return F.struct((acc["at"] + v).alias("at"), F.concat(F.coalesce(acc["out"], F.expr("cast(array() as array<double>)")), F.array(acc["at"] + v)).alias("out"))

    def whole(acc: Column, run: Column) -> Column:
        inner = F.aggregate(run, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.coalesce(x["out"], F.expr("cast(array() as array<double>)")))).alias("out")))[0]

    return F.flatten(F.aggregate(runs, F.struct(F.lit(0.0).alias("at"), F.array(F.array(F.lit(0.0))).alias("out")), whole)["out"])


def after(path: Column) -> Column:
    """The path rotated by one: each point's successor in the ring."""
    return let(path, lambda p: F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)))


def segments(path: Column, closed: bool = False) -> Column:
    """array<struct<a, b>> of a path's sides."""
    both = let(path, lambda p: F.arrays_zip(p.alias("a"), F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)).alias("b")))
    return both if closed else let(both, lambda sides: F.slice(sides, 1, F.greatest(F.size(sides) - 1, F.lit(0))))


def _sum(items: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + term(s))


def signed_area(path: Column) -> Column:
    """Shoelace; 0 for fewer than three points."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    return let(path, lambda p: F.when(F.size(p) < 3, 0.0).otherwise(_sum(segments(p, True), cross) / 2))


def is_positive(path: Column) -> Column:
    return signed_area(path) >= 0


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def length(path: Column, closed: bool = False) -> Column:
    return _sum(segments(path, closed), lambda s: distance(s["a"], s["b"]))


def bounds(path: Column) -> Column:
    return let(path, _bounds)


def _bounds(path: Column) -> Column:
    x, y = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))


def centroid(path: Column) -> Column:
    """Of a ring's area; null where the area is 0."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]

    def of(sides: Column) -> Column:
        cx, cy = _sum(sides, lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)), _sum(sides, lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s))
        area = F.when(F.size(sides) < 3, 0.0).otherwise(_sum(sides, cross) / 2)
        return let(area * 6, lambda six: F.when(six != 0, F.struct((cx / six).alias("x"), (cy / six).alias("y"))))

    return let(segments(path, True), of)


def centroid_compat(path: Column) -> Column:
    """As `centroid`, but with the absolute values of both coordinates."""
    return let(centroid(path), lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["x"]).alias("x"), F.abs(c["y"]).alias("y"))))


def cross_product(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


def dot_product(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"])


def is_collinear(a: Column, b: Column, c: Column) -> Column:
    """Exact for integer coordinates: products of 38 digits."""
    d = lambda p, q, k: (p[k].cast("decimal(19,0)") - q[k].cast("decimal(19,0)")).cast("decimal(19,0)")
    return d(b, a, "x") * d(c, b, "y") == d(b, a, "y") * d(c, b, "x")


def mid_point(a: Column, b: Column) -> Column:
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def distance_squared(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])


def near_equal(a: Column, b: Column, limit_squared: float) -> Column:
    return distance_squared(a, b) < limit_squared


def near_collinear(a: Column, b: Column, c: Column, sin_squared_min: float) -> Column:
    cp = cross_product(a, b, c)
    return cp * cp / (distance_squared(b, a) * distance_squared(c, b)) < sin_squared_min


def perpendicular_squared(p: Column, a: Column, b: Column) -> Column:
    """Squared distance of p to the line through a and b; 0 where they coincide."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = (p["x"] - a["x"]) * dy - (p["y"] - a["y"]) * dx
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(n * n / (dx * dx + dy * dy))


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.least(F.greatest(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n, F.lit(0.0)), F.lit(1.0)))
    return point(a["x"] + t * dx, a["y"] + t * dy)


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the line of c and d meets that of a and b, clamped to the segment a..b; null for parallels."""
    dx1, dy1, dx2, dy2 = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    det = dy1 * dx2 - dy2 * dx1
    t = F.least(F.greatest(((a["x"] - c["x"]) * dy2 - (a["y"] - c["y"]) * dx2) / det, F.lit(0.0)), F.lit(1.0))
    return F.when(det != 0, point(a["x"] + t * dx1, a["y"] + t * dy1))


def segments_cross(a: Column, b: Column, c: Column, d: Column, inclusive: bool = False) -> Column:
    s = lambda p, q, r: F.signum(cross_product(p, q, r))
    s1, s2, s3, s4 = s(a, c, d), s(b, c, d), s(c, a, b), s(d, a, b)
    if not inclusive:
        return (s1 * s2 < 0) & (s3 * s4 < 0)
    return (s1 * s2 <= 0) & (s3 * s4 <= 0) & ((s1 != 0) | (s2 != 0) | (s3 != 0) | (s4 != 0))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """'On', 'Inside' or 'Outside', by even-odd; a ring of fewer than three points has no inside."""
    on_side = lambda s: (
        ((s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) == (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"]))
        & x.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"]))
        & y.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))
    )
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])

    def place(sides: Column) -> Column:
        odd = F.size(F.filter(sides, lambda s: F.when(s["a"]["y"] != s["b"]["y"], crosses(s)).otherwise(False))) % 2 == 1
        return F.when(F.size(sides) < 3, "Outside").when(F.exists(sides, on_side), "On").when(odd, "Inside").otherwise("Outside")

    return let(segments(ring, True), place)


def point_in_polygon(x: Column, y: Column, outer: Column, holes: Column) -> Column:
    """Within the outer ring and within no hole."""
    return (point_in_ring(x, y, outer) == "Inside") & ~F.exists(holes, lambda h: point_in_ring(x, y, h) == "Inside")


def contains_path(inner: Column, outer: Column) -> Column:
    """Most of the inner path's points that are not on the outer ring lie inside; of a tie, its box's middle decides."""
    vote = F.aggregate(inner, F.lit(0), lambda acc, p: acc + F.when(point_in_ring(p["x"], p["y"], outer) == "Inside", 1).when(point_in_ring(p["x"], p["y"], outer) == "Outside", -1).otherwise(0))
    b = bounds(inner)
    return F.when(vote != 0, vote > 0).otherwise(point_in_ring((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2, outer) != "Outside")


def translate(path: Column, dx: float, dy: float) -> Column:
    return F.transform(path, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(path: Column, sx: float, sy: float) -> Column:
    return F.transform(path, lambda p: point(p["x"] * sx, p["y"] * sy))


def reflect(p: Column, pivot: Column) -> Column:
    return point(pivot["x"] * 2 - p["x"], pivot["y"] * 2 - p["y"])


def snap(path: Column, grid: float) -> Column:
    return F.transform(path, lambda p: point(F.round(p["x"] / grid) * grid, F.round(p["y"] / grid) * grid))


def strip_duplicates(path: Column, closed: bool = False) -> Column:
    """Without points that repeat the one before, and, if closed, without ends that repeat the first."""
    kept = let(path, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))
    if not closed:
        return kept
    return let(kept, lambda ps: F.when((F.size(ps) > 1) & (F.try_element_at(ps, F.lit(-1)) == F.try_element_at(ps, F.lit(1))), F.slice(ps, 1, F.size(ps) - 1)).otherwise(ps))


def strip_near_equal(path: Column, limit_squared: float) -> Column:
    """Without points nearer than the limit to the last one kept."""
    return F.aggregate(path, F.slice(path, 1, 1), lambda acc, p: F.when(distance_squared(F.element_at(acc, -1), p) < limit_squared, acc).otherwise(F.concat(acc, F.array(p))))


def ellipse(cx: Column, cy: Column, rx: float, ry: float, steps: int = 0) -> Column:
    import math

    n = steps if steps > 2 else max(3, int(math.pi * math.sqrt((rx + ry) / 2)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(cx + rx * F.cos(i * (2 * math.pi / n)), cy + ry * F.sin(i * (2 * math.pi / n))))
