"""Questions to and rebuildings of the canonical geometry column, as JVM-side expressions.

Every function takes columns and gives null for a null geometry. Parts are 1 points, 2 lines, 3 outer and 4 inner rings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mbr, path
from .textgeom import DIMS, KINDS

_POINT = "struct<x:double,y:double,z:double,m:double>"
_PARTS = f"array<struct<ptype:tinyint,points:array<{_POINT}>>>"
_POLYGONS = (3, 4)


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def _double(v: Column | float | None) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: plans stay small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def vertex(x: Column | float, y: Column | float, z: Column | float | None = None, m: Column | float | None = None) -> Column:
    return F.struct(_double(x).alias("x"), _double(y).alias("y"), _double(z).alias("z"), _double(m).alias("m"))


def part(ptype: int, points: Column) -> Column:
    return F.struct(F.lit(ptype).cast("tinyint").alias("ptype"), points.cast(f"array<{_POINT}>").alias("points"))


def whole(kind: Column | str, parts: Column, dim: Column | str = "XY", srid: Column | int = 0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(srid).cast("int").alias("srid"), lit(dim).alias("dim"), lit(kind).alias("kind"), parts.cast(_PARTS).alias("parts"))


# --- counts and kinds ----------------------------------------------------------------------------------------------


def _typed(parts: Column, *ptypes: int) -> Column:
    return F.filter(parts, lambda p: p["ptype"].isin(*ptypes))


def parts_of(g: Column, *ptypes: int) -> Column:
    """The parts of the types given, in order; of all types by default."""
    return _typed(g["parts"], *ptypes) if ptypes else g["parts"]


def points_of(g: Column) -> Column:
    return F.flatten(F.transform(g["parts"], lambda p: p["points"]))


def point_count(g: Column) -> Column:
    return F.aggregate(g["parts"], F.lit(0), lambda acc, p: acc + F.size(p["points"]))


def part_count(g: Column) -> Column:
    return F.size(g["parts"])


def polygon_count(g: Column) -> Column:
    return F.size(parts_of(g, 3))


def part_first_point(g: Column, i: Column | int) -> Column:
    """How many vertices precede part i."""
    return F.aggregate(F.slice(g["parts"], F.lit(1), i if isinstance(i, Column) else F.lit(i)), F.lit(0), lambda acc, p: acc + F.size(p["points"]))


def polygon_first_part(g: Column) -> Column:
    """The index of every polygon's outer ring."""
    return F.filter(F.transform(g["parts"], lambda p, i: F.when(p["ptype"] == 3, i)), lambda i: i.isNotNull())


def polygon_part_count(g: Column) -> Column:
    """The number of every polygon's rings."""
    first = polygon_first_part(g)
    total = F.size(F.filter(g["parts"], lambda p: p["ptype"].isin(*_POLYGONS)))
    return F.transform(first, lambda at, i: F.coalesce(F.get(first, i + 1), first[0] + total) - at)


def vertex_at(g: Column, i: Column | int) -> Column:
    """Vertex i of all parts, null outside."""
    return F.get(points_of(g), i)


def map_vertices(g: Column, f: Callable[[Column], Column]) -> Column:
    """f of every vertex, which gives a vertex."""
    return g.withField("parts", F.transform(g["parts"], lambda p: p.withField("points", F.transform(p["points"], f))))


def dimension(g: Column) -> Column:
    """0 where there are only points, 1 with lines, 2 with polygons, null where there is nothing."""
    return F.array_max(F.transform(g["parts"], lambda p: F.least(p["ptype"].cast("int"), F.lit(3)) - 1))


def type_code(g: Column) -> Column:
    """1 to 7 by kind, and 1000 a dimension: XYZ 1001 to 1007, XYM 2001, XYZM 3001."""
    kind, dim = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, DIMS))
    return (F.array_position(kind, g["kind"]) + 1000 * (F.array_position(dim, g["dim"]) - 1)).cast("int")


def is_empty(g: Column) -> Column:
    return point_count(g) == 0


def _same_place(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"]) & a["z"].eqNullSafe(b["z"])


def is_closed(g: Column) -> Column:
    """Whether there are lines and only lines, each of which ends where it starts."""
    only = (F.size(parts_of(g, 2)) > 0) & (F.size(parts_of(g, 2)) == F.size(g["parts"]))
    return only & F.forall(g["parts"], lambda p: _same_place(F.get(p["points"], F.lit(0)), F.element_at(p["points"], -1)))


def has_open_ring(g: Column) -> Column:
    return F.exists(parts_of(g, *_POLYGONS), lambda p: (F.size(p["points"]) > 0) & ~_same_place(F.get(p["points"], F.lit(0)), F.element_at(p["points"], -1)))


def is_toxic(g: Column) -> Column:
    """Lines of fewer than two points, or rings of fewer than four."""
    return F.exists(g["parts"], lambda p: ((p["ptype"] == 2) & (F.size(p["points"]) < 2)) | (p["ptype"].isin(*_POLYGONS) & (F.size(p["points"]) < 4)))


# --- boxes and ranges ----------------------------------------------------------------------------------------------


def bounds(g: Column) -> Column:
    return path.bounds(points_of(g))


def _range(g: Column, axis: str, no_data: float | None) -> Column:
    v = F.filter(F.transform(points_of(g), lambda p: p[axis]), lambda z: z.isNotNull() if no_data is None else z.isNotNull() & (z != no_data))
    return F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))


def z_range(g: Column, no_data: float | None = None) -> Column:
    """Lowest and highest z; nulls without any. A no-data value is left out."""
    return _range(g, "z", no_data)


def m_range(g: Column, no_data: float | None = None) -> Column:
    return _range(g, "m", no_data)


def box_polygon(x1: Column, y1: Column, x2: Column, y2: Column, srid: int = 0) -> Column:
    """The rectangle of two opposite corners."""
    lx, ly, hx, hy = F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)
    ring = F.array(vertex(lx, ly), vertex(hx, ly), vertex(hx, hy), vertex(lx, hy), vertex(lx, ly))
    return whole("Polygon", F.array(part(3, ring)), srid=srid)


def circle_box(x: Column, y: Column, radius: Column | float, srid: int = 0) -> Column:
    """The square around a circle."""
    return box_polygon(x - radius, y - radius, x + radius, y + radius, srid)


# --- building ------------------------------------------------------------------------------------------------------


def make_point(x: Column, y: Column, z: Column | None = None, m: Column | None = None, srid: int = 0) -> Column:
    dim = "XY" + ("Z" if z is not None else "") + ("M" if m is not None else "")
    return whole("Point", F.array(part(1, F.array(vertex(x, y, z, m)))), dim, srid)


def make_line(a: Column, b: Column) -> Column:
    """The line from one point geometry to another; its dimension has what both have."""
    both = F.when(a["dim"] == b["dim"], a["dim"]).otherwise("XY")
    return whole("LineString", F.array(part(2, F.concat(points_of(a), points_of(b)))), both, a["srid"])


def make_polygon(outer: Column, *holes: Column) -> Column:
    """A polygon of closed lines of four points and more; null where one is not."""
    rings = [part(3 if i == 0 else 4, points_of(g)) for i, g in enumerate((outer, *holes))]
    fine = [(g["kind"] == "LineString") & is_closed(g) & (point_count(g) >= 4) for g in (outer, *holes)]
    ok = fine[0]
    for f in fine[1:]:
        ok = ok & f
    return F.when(ok, whole("Polygon", F.array(*rings), outer["dim"], outer["srid"]))


def _kind(parts: Column) -> Column:
    """The narrowest kind of parts, by the families there are and how many members."""
    n = [F.size(_typed(parts, t)) for t in (1, 2, 3)]
    one = lambda i: (n[i] == 1) & (n[(i + 1) % 3] == 0) & (n[(i + 2) % 3] == 0)
    many = lambda i: (n[i] > 1) & (n[(i + 1) % 3] == 0) & (n[(i + 2) % 3] == 0)
    out = F.when(one(0), KINDS[0])
    for i in (1, 2):
        out = out.when(one(i), KINDS[i])
    for i in (0, 1, 2):
        out = out.when(many(i), KINDS[i + 3])
    return out.otherwise(KINDS[6])


def _narrow(parts: Column, dim: Column, srid: Column) -> Column:
    """The geometry of parts in its narrowest kind; null where there are none."""
    return _let(parts, lambda ps: F.when(F.size(ps) > 0, whole(_kind(ps), ps, dim, srid)))


def merge(a: Column, b: Column) -> Column:
    """The parts of both, points before lines before polygons; the SRID of a."""
    dim = F.when(a["dim"] == b["dim"], a["dim"]).otherwise("XY")
    every = F.concat(a["parts"], b["parts"])
    ordered = _let(every, lambda ps: F.concat(_typed(ps, 1), _typed(ps, 2), _typed(ps, *_POLYGONS)))
    return _narrow(ordered, dim, a["srid"])


def _extract(g: Column, *ptypes: int) -> Column:
    """Only parts of these types; null where there are none."""
    return _narrow(parts_of(g, *ptypes), g["dim"], g["srid"])


def reverse(g: Column) -> Column:
    """Lines and rings the other way round; their order stays."""
    return g.withField("parts", F.transform(g["parts"], lambda p: p.withField("points", F.reverse(p["points"]))))


def wind(g: Column, outer_clockwise: bool = True) -> Column:
    """Rings turned so that outer ones go clockwise (or not) and inner ones the other way; other parts stay."""
    wrong = lambda p: p["ptype"].isin(*_POLYGONS) & (clockwise(p["points"]) != ((p["ptype"] == 3) == F.lit(outer_clockwise)))
    return g.withField("parts", F.transform(g["parts"], lambda p: p.withField("points", F.when(wrong(p), F.reverse(p["points"])).otherwise(p["points"]))))


def extract_points(g: Column) -> Column:
    return _extract(g, 1)


def extract_lines(g: Column) -> Column:
    return _extract(g, 2)


def extract_polygons(g: Column) -> Column:
    return _extract(g, *_POLYGONS)


def dissolve_points(g: Column) -> Column:
    """All vertices as points."""
    return _narrow(F.transform(points_of(g), lambda p: part(1, F.array(p))), g["dim"], g["srid"])


def dissolve_segments(g: Column) -> Column:
    """Every side of lines and rings as a line of its own, points kept; sides without length go."""
    sides = F.flatten(F.transform(g["parts"], lambda p: F.when(p["ptype"] == 1, F.array(part(1, p["points"]))).otherwise(
        F.transform(F.filter(path.segments(p["points"]), lambda s: ~_same_place(s["a"], s["b"])), lambda s: part(2, F.array(s["a"], s["b"]))))))
    return _narrow(sides, g["dim"], g["srid"])


def linearize(g: Column) -> Column:
    """Rings as lines; other parts go."""
    rings = F.transform(parts_of(g, *_POLYGONS), lambda p: part(2, p["points"]))
    return _narrow(rings, g["dim"], g["srid"])


# --- dimensions ----------------------------------------------------------------------------------------------------


def cast_dim(g: Column, dim: str, z: float = 0.0, m: float = 0.0) -> Column:
    """The geometry in another dimension: what is missing gets a value, what is too much goes."""
    if dim not in DIMS:
        raise ValueError(f"unknown dimension {dim!r}")
    none = F.lit(None).cast("double")
    zed = (lambda p: F.coalesce(p["z"], F.lit(float(z)))) if "Z" in dim else (lambda p: none)
    measure = (lambda p: F.coalesce(p["m"], F.lit(float(m)))) if "M" in dim else (lambda p: none)
    return map_vertices(g, lambda p: vertex(p["x"], p["y"], zed(p), measure(p))).withField("dim", F.lit(dim))


# --- repair --------------------------------------------------------------------------------------------------------


def close_rings(g: Column) -> Column:
    """Rings that don't end where they start get their first point again."""
    closed = lambda p: F.when(p["ptype"].isin(*_POLYGONS) & (F.size(p["points"]) > 0) & ~_same_place(F.get(p["points"], F.lit(0)), F.element_at(p["points"], -1)), F.concat(p["points"], F.slice(p["points"], 1, 1))).otherwise(p["points"])
    return g.withField("parts", F.transform(g["parts"], lambda p: p.withField("points", closed(p))))


def _without_repeats(points: Column) -> Column:
    return F.filter(points, lambda p, i: (i == 0) | ~_same_place(p, F.get(points, i - 1)))


def remove_repeated_points(g: Column) -> Column:
    """Consecutive equal vertices of lines and rings once; equal point parts once, the first stays."""
    lone = F.transform(g["parts"], lambda p: F.when(p["ptype"] == 1, F.get(p["points"], F.lit(0))))
    kept = F.filter(g["parts"], lambda p, i: (p["ptype"] != 1) | ~F.exists(F.slice(lone, F.lit(1), i), lambda q: _same_place(q, F.get(p["points"], F.lit(0)))))
    return g.withField("parts", F.transform(kept, lambda p: F.when(p["ptype"] == 1, p).otherwise(p.withField("points", _without_repeats(p["points"])))))


def sanitize(g: Column) -> Column:
    """Repeated vertices out of lines and rings, then lines and rings that are toxic: a toxic outer ring takes its
    inner rings with it. Null where nothing is left."""
    clean = F.transform(g["parts"], lambda p: p.withField("points", F.when(p["ptype"] == 1, p["points"]).otherwise(_without_repeats(p["points"]))))
    fine = lambda p: F.coalesce(p["ptype"] == 1, F.lit(False)) | ((p["ptype"] == 2) & (F.size(p["points"]) >= 2)) | (p["ptype"].isin(*_POLYGONS) & (F.size(p["points"]) >= 4))
    owner = lambda ps, i: F.try_element_at(_typed(F.slice(ps, F.lit(1), i + 1), 3), F.lit(-1))
    kept = _let(clean, lambda ps: F.filter(ps, lambda p, i: fine(p) & ((p["ptype"] != 4) | F.coalesce(fine(owner(ps, i)), F.lit(False)))))
    return _let(kept, lambda ps: F.when(F.size(ps) > 0, g.withField("parts", ps)))


def snap_to_grid(g: Column, size_x: float, size_y: float | None = None, size_z: float = 0.0, size_m: float = 0.0, origin: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> Column:
    """Vertices on a grid, 0 leaves an axis alone; what collapses goes as in `sanitize`."""
    sizes = (size_x, size_x if size_y is None else size_y, size_z, size_m)
    at = lambda v, s, o: F.floor((v - o) / s + 0.5) * s + o if s > 0 else v
    return sanitize(map_vertices(g, lambda p: vertex(*[at(p[n], s, o) for n, s, o in zip("xyzm", sizes, origin, strict=True)])))


# --- measures ------------------------------------------------------------------------------------------------------


def up_down_height(line: Column) -> Column:
    """The heights climbed and descended along a path of x, y, z."""
    step = F.transform(path.segments(line), lambda s: F.coalesce(s["b"]["z"], F.lit(0.0)) - F.coalesce(s["a"]["z"], F.lit(0.0)))
    total = lambda f: F.aggregate(F.transform(step, f), F.lit(0.0), lambda acc, v: acc + v)
    return F.struct(total(lambda v: F.greatest(v, F.lit(0.0))).alias("up"), total(lambda v: F.greatest(-v, F.lit(0.0))).alias("down"))


def curvosity(line: Column, extra_points: int = 0) -> Column:
    """The length of a reference line over that of a path; null without length. The reference line goes from the path's
    start to its end by way of so many places that cut the path evenly: 1 for a straight line, 0 for a closed one without them."""
    long = path.length(line)
    if extra_points < 0:
        raise ValueError("a reference line has no fewer than its two ends")
    if not extra_points:
        return F.when(long > 0, path.distance(F.get(line, F.lit(0)), F.element_at(line, -1)) / long)

    def index(upto: Column) -> Column:
        total = F.element_at(upto, -1)
        sides = F.arrays_zip(path.segments(line).alias("s"), F.slice(upto, F.lit(1), F.size(upto) - 1).alias("from"), F.slice(upto, F.lit(2), F.size(upto) - 1).alias("to"))
        places = [F.get(line, F.lit(0))]
        for i in range(1, extra_points + 1):
            at = total * (i / (extra_points + 1))
            on = F.get(F.filter(sides, lambda s: (s["to"] >= at) & (s["to"] > s["from"])), F.lit(0))  # noqa: B023
            share = (at - on["from"]) / (on["to"] - on["from"])
            places.append(path.point(on["s"]["a"]["x"] + share * (on["s"]["b"]["x"] - on["s"]["a"]["x"]), on["s"]["a"]["y"] + share * (on["s"]["b"]["y"] - on["s"]["a"]["y"])))
        places.append(F.element_at(line, -1))
        reference = path.of_points(*places)
        return F.when(total > 0, path.length(reference) / total)

    return F.when(F.size(line) > 1, _let(_lengths(line), index))


def min_distance(p: Column, line: Column) -> Column:
    """From a point to the nearest place of a path; null for an empty one."""
    sides = F.transform(path.segments(line), lambda s: path.distance(p, path.closest_on_segment(p, s["a"], s["b"])))
    ends = F.transform(line, lambda v: path.distance(p, v))
    return F.array_min(F.concat(ends, sides))


def clockwise(ring: Column) -> Column:
    """Whether a ring turns right, with y upward."""
    return path.signed_area(ring) < 0


def _lengths(points: Column) -> Column:
    """Length along a path up to every vertex."""
    return path.running(F.transform(path.segments(points), lambda s: path.distance(s["a"], s["b"])))


def add_measure(g: Column, start: float | Column, end: float | Column) -> Column:
    """Lines with measures that go evenly from start to end along all of them; null for what is not lines only."""
    lines = g["parts"]
    total = F.aggregate(lines, F.lit(0.0), lambda acc, p: acc + path.length(p["points"]))
    s, e = _double(start), _double(end)
    at = lambda run: F.when(total > 0, s + (e - s) * run / total).otherwise(s)
    ahead = path.running(F.transform(lines, lambda p: path.length(p["points"])))
    line = lambda p, far: p.withField("points", F.zip_with(p["points"], _lengths(p["points"]), lambda q, v: vertex(q["x"], q["y"], q["z"], at(far + v))))
    measured = _let(ahead, lambda far: F.transform(lines, lambda p, i: _let(F.get(far, i), lambda v: line(p, v))))
    dim = F.when(g["dim"].contains("Z"), "XYZM").otherwise("XYM")
    only = (F.size(lines) > 0) & F.forall(lines, lambda p: p["ptype"] == 2)
    return F.when(only, whole(g["kind"], measured, dim, g["srid"]))


def _measured_line(g: Column) -> Column:
    return (g["kind"] == "LineString") & g["dim"].contains("M") & (part_count(g) == 1)


def measure_at_point(g: Column, p: Column) -> Column:
    """The measure of a measured line at its place nearest to a point; of equal places the first."""
    sides = path.segments(g["parts"][0]["points"])

    def side(s: Column) -> Column:
        q = path.closest_on_segment(p, s["a"], s["b"])
        n = path.distance(s["a"], s["b"])
        t = F.when(n > 0, path.distance(s["a"], q) / n).otherwise(0.0)
        return F.struct(path.distance(p, q).alias("d"), (s["a"]["m"] + t * (s["b"]["m"] - s["a"]["m"])).alias("m"))

    found = F.transform(sides, lambda s, i: _let(side(s), lambda v: F.struct(v["d"].alias("d"), i.alias("i"), v["m"].alias("m"))))
    return F.when(_measured_line(g), F.array_min(found)["m"])


def is_trajectory(g: Column) -> Column:
    """A measured line whose measures grow from vertex to vertex."""
    grow = F.forall(path.segments(g["parts"][0]["points"]), lambda s: s["b"]["m"] > s["a"]["m"])
    return F.when(g.isNotNull(), F.coalesce(_measured_line(g) & (point_count(g) > 1) & grow, F.lit(False)))


def _between(s: Column, m: Column) -> Column:
    t = F.when(s["a"]["m"] == s["b"]["m"], 0.0).otherwise((m - s["a"]["m"]) / (s["b"]["m"] - s["a"]["m"]))
    mix = lambda n: s["a"][n] + t * (s["b"][n] - s["a"][n])
    return vertex(mix("x"), mix("y"), mix("z"), m)


def trajectory_point(g: Column, m: float | Column) -> Column:
    """Where a trajectory is at a measure; null outside its measures and for what is no trajectory."""
    m = _double(m)
    side = F.get(F.filter(path.segments(g["parts"][0]["points"]), lambda s: m.between(s["a"]["m"], s["b"]["m"])), F.lit(0))
    return F.when(is_trajectory(g) & side.isNotNull(), whole("Point", F.array(part(1, F.array(_between(side, m)))), g["dim"], g["srid"]))


def locate_between(g: Column, low: float | Column, high: float | Column) -> Column:
    """The stretches of measured points and lines between two measures, ends included: lines cut at the measures, and
    points where a stretch has no length. Null for unmeasured geometries, polygons, and where there is nothing."""
    lo, hi = F.least(_double(low), _double(high)), F.greatest(_double(low), _double(high))

    def cut(s: Column) -> Column:
        """One side's stretch, as an array of none, one or two vertices."""
        down = s["a"]["m"] > s["b"]["m"]
        least, most = F.least(s["a"]["m"], s["b"]["m"]), F.greatest(s["a"]["m"], s["b"]["m"])
        first, last = F.greatest(lo, least), F.least(hi, most)
        flat = F.when(least == most, F.array(s["a"], s["b"])).when(first == last, F.array(_between(s, first)))
        return F.when(first > last, _nothing(f"array<{_POINT}>")).otherwise(F.coalesce(flat, F.when(down, F.array(_between(s, last), _between(s, first))).otherwise(F.array(_between(s, first), _between(s, last)))))

    def runs(points: Column) -> Column:
        """Stretches of consecutive sides joined where one starts where the one before ends."""
        start = _nothing(f"array<array<{_POINT}>>")

        def step(acc: Column, c: Column) -> Column:
            last = F.element_at(acc, -1)
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.slice(c, F.lit(2), F.size(c)))))
            meets = (F.size(acc) > 0) & F.coalesce(_same_place(F.try_element_at(last, F.lit(-1)), F.get(c, F.lit(0))), F.lit(False))
            return F.when(F.size(c) == 0, acc).when(meets, joined).otherwise(F.concat(acc, F.array(c)))

        guarded = lambda acc, c: F.when(F.size(acc) == 0, F.when(F.size(c) == 0, acc).otherwise(F.array(c))).otherwise(step(acc, c))
        return F.aggregate(F.transform(path.segments(points), cut), start, guarded)

    found = F.flatten(F.transform(g["parts"], lambda p: F.when(p["ptype"] == 1, F.when(F.get(p["points"], F.lit(0))["m"].between(lo, hi), F.array(p)).otherwise(_nothing(_PARTS))).otherwise(
        F.transform(runs(p["points"]), lambda r: F.when(F.size(r) > 1, part(2, r)).otherwise(part(1, r))))))
    ordered = _let(found, lambda ps: F.concat(_typed(ps, 1), _typed(ps, 2)))
    fits = g["dim"].contains("M") & ~F.exists(g["parts"], lambda p: p["ptype"].isin(*_POLYGONS))
    return F.when(fits, _narrow(ordered, g["dim"], g["srid"]))


def area_of(g: Column) -> Column:
    """Outer rings less inner ones, whatever way they turn."""
    return F.aggregate(parts_of(g, *_POLYGONS), F.lit(0.0), lambda acc, p: acc + F.when(p["ptype"] == 3, 1.0).otherwise(-1.0) * F.abs(path.signed_area(p["points"])))


def length_of(g: Column) -> Column:
    return F.aggregate(parts_of(g, 2), F.lit(0.0), lambda acc, p: acc + path.length(p["points"]))


def overlaps_box(g: Column, box: Column) -> Column:
    """Whether a geometry's bounds and a box meet: the test before any exact one."""
    return mbr.intersects(bounds(g), box)
