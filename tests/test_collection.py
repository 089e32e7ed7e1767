import pytest
from pyspark.sql import functions as F

from quillgrid.functions import collection as C
from quillgrid.functions import path
from quillgrid.functions import textgeom as G


@pytest.fixture(scope="module")
def ask(spark):
    """ask(f, text, ...): f of the geometries of the texts, as a value or, for a geometry, as text."""

    def run(f, *texts):
        df = spark.createDataFrame([texts], ", ".join(f"t{i} string" for i in range(len(texts))))
        df = df.select(*[G.st_from_wkt(F.col(f"t{i}")).alias(f"g{i}") for i in range(len(texts))])
        v = df.select(f(*[F.col(f"g{i}") for i in range(len(texts))]).alias("v")).first()["v"]
        if hasattr(v, "asDict"):
            d = v.asDict(recursive=True)
            return G.to_wkt(G.of_struct(d)) if "parts" in d else d
        return v

    return run


SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
MIX = "GEOMETRYCOLLECTION(POINT(9 9), LINESTRING(0 0, 3 4), POLYGON((0 0, 1 0, 1 1, 0 0)))"


def test_counts_and_kinds(ask):
    two = "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((5 5, 9 5, 9 9, 5 5)))"
    assert ask(C.point_count, two) == 12 and ask(C.part_count, two) == 3 and ask(C.polygon_count, two) == 2
    assert ask(C.polygon_first_part, two) == [0, 2] and ask(C.polygon_part_count, two) == [2, 1]
    assert ask(lambda g: C.part_first_point(g, 2), two) == 8 and ask(lambda g: C.vertex_at(g, 9)["x"], two) == 9.0
    assert ask(lambda g: C.vertex_at(g, 99)["x"], two) is None
    assert [ask(C.dimension, t) for t in ("POINT(1 1)", "LINESTRING(0 0, 1 1)", MIX, "LINESTRING EMPTY")] == [0, 1, 2, None]
    assert [ask(C.type_code, t) for t in ("POINT(1 1)", "POLYGON Z((0 0 1, 1 0 1, 1 1 1, 0 0 1))", "MULTIPOINT M(1 2 3)", MIX)] == [1, 1003, 2004, 7]
    assert ask(C.is_empty, "POINT EMPTY") is True and ask(C.is_empty, MIX) is False
    assert ask(C.is_closed, "LINESTRING(0 0, 1 1, 0 0)") is True and ask(C.is_closed, "LINESTRING(0 0, 1 1)") is False and ask(C.is_closed, SQUARE) is False
    assert ask(C.area_of, SQUARE) == 15.5 and ask(C.length_of, MIX) == 5.0
    assert ask(lambda g: C.z_range(g, 0.0), "LINESTRING Z(0 0 0, 1 1 5, 2 2 -1)") == {"low": -1.0, "high": 5.0} and ask(C.m_range, "POINT(1 1)") == {"low": None, "high": None}
    assert ask(C.point_count, None) is None and ask(C.sanitize, None) is None


def test_building(ask):
    assert ask(C.make_line, "POINT(0 0)", "POINT(1 2)") == "LINESTRING(0 0, 1 2)"
    assert ask(lambda a, b: C.make_polygon(a, b), "LINESTRING(0 0, 4 0, 4 4, 0 0)", "LINESTRING(1 1, 2 1, 2 2, 1 1)") == "POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"
    assert ask(C.make_polygon, "LINESTRING(0 0, 4 0, 4 4)") is None
    assert ask(C.merge, "LINESTRING(0 0, 1 1)", "POINT(5 5)") == "GEOMETRYCOLLECTION(POINT(5 5), LINESTRING(0 0, 1 1))"
    assert ask(C.merge, "POINT(1 1)", "POINT(5 5)") == "MULTIPOINT(1 1, 5 5)"
    assert ask(C.extract_lines, MIX) == "LINESTRING(0 0, 3 4)" and ask(C.extract_points, SQUARE) is None and ask(C.extract_polygons, MIX) == "POLYGON((0 0, 1 0, 1 1, 0 0))"
    assert ask(C.dissolve_points, "LINESTRING(0 0, 1 1)") == "MULTIPOINT(0 0, 1 1)"
    assert ask(C.dissolve_segments, "LINESTRING(0 0, 1 1, 1 1, 2 0)") == "MULTILINESTRING((0 0, 1 1), (1 1, 2 0))"
    assert ask(C.linearize, "POLYGON((0 0, 1 0, 1 1, 0 0))") == "LINESTRING(0 0, 1 0, 1 1, 0 0)"
    assert ask(lambda g: C.circle_box(F.lit(1.0), F.lit(2.0), 1.0), "POINT(0 0)") == "POLYGON((0 1, 2 1, 2 3, 0 3, 0 1))"
    assert ask(lambda g: C.cast_dim(g, "XYZM", 7, 8), "LINESTRING Z(0 0 1, 1 1 2)") == "LINESTRING ZM(0 0 1 8, 1 1 2 8)"
    assert ask(lambda g: C.cast_dim(g, "XY"), "POINT ZM(1 2 3 4)") == "POINT(1 2)"


def test_repair(ask):
    assert ask(C.close_rings, "POLYGON((0 0, 1 0, 1 1))") == "POLYGON((0 0, 1 0, 1 1, 0 0))"
    assert ask(C.has_open_ring, "POLYGON((0 0, 1 0, 1 1))") is True and ask(C.has_open_ring, SQUARE) is False
    assert ask(C.remove_repeated_points, "MULTIPOINT(1 1, 2 2, 1 1)") == "MULTIPOINT(1 1, 2 2)"
    assert ask(C.remove_repeated_points, "LINESTRING(0 0, 0 0, 1 1, 1 1, 0 0)") == "LINESTRING(0 0, 1 1, 0 0)"
    assert ask(C.sanitize, "POLYGON((0 0, 1 0, 1 0, 0 0), (0 0, 1 0, 1 1, 0 0))") is None
    assert ask(C.sanitize, "MULTILINESTRING((0 0, 0 0), (1 1, 2 2))") == "MULTILINESTRING((1 1, 2 2))"
    assert ask(C.is_toxic, "LINESTRING(0 0)") is True
    assert ask(lambda g: C.snap_to_grid(g, 1.0), "LINESTRING(0.2 0.2, 0.4 0.1, 1.6 2.5)") == "LINESTRING(0 0, 2 3)"


def test_measures(ask):
    line = "LINESTRING(0 0, 3 4, 3 9)"
    assert ask(lambda g: C.add_measure(g, 0, 10), line) == "LINESTRING M(0 0 0, 3 4 5, 3 9 10)"
    assert ask(lambda g: C.add_measure(g, 0, 10), "MULTILINESTRING((0 0, 5 0), (0 1, 5 1))") == "MULTILINESTRING M((0 0 0, 5 0 5), (0 1 5, 5 1 10))"
    assert ask(lambda g: C.add_measure(g, 0, 1), SQUARE) is None
    m = "LINESTRING M(0 0 0, 10 0 10, 10 10 20)"
    at = lambda x, y: path.point(F.lit(float(x)), F.lit(float(y)))
    assert ask(lambda g: C.measure_at_point(g, at(4, 3)), m) == 4.0 and ask(lambda g: C.measure_at_point(g, at(4, 3)), line) is None
    assert ask(C.is_trajectory, m) is True and ask(C.is_trajectory, "LINESTRING M(0 0 5, 1 1 5)") is False and ask(C.is_trajectory, line) is False
    assert ask(lambda g: C.trajectory_point(g, 15), m) == "POINT M(10 5 15)" and ask(lambda g: C.trajectory_point(g, 21), m) is None
    assert ask(lambda g: C.locate_between(g, 5, 15), m) == "LINESTRING M(5 0 5, 10 0 10, 10 5 15)"
    assert ask(lambda g: C.locate_between(g, 20, 30), m) == "POINT M(10 10 20)" and ask(lambda g: C.locate_between(g, 30, 40), m) is None
    assert ask(lambda g: C.locate_between(g, 0, 5), "LINESTRING M(0 0 0, 10 0 10, 20 0 0)") == "MULTILINESTRING M((0 0 0, 5 0 5), (15 0 5, 20 0 0))"
    assert ask(lambda g: C.locate_between(g, 1, 2), "MULTIPOINT M(0 0 1, 1 1 3)") == "POINT M(0 0 1)"
    pts = lambda f: lambda g: f(C.points_of(g))
    assert ask(pts(C.curvosity), "LINESTRING(0 0, 1 0, 1 1, 0 1, 0 0)") == 0.0 and ask(pts(C.curvosity), "LINESTRING(0 0, 3 4)") == 1.0
    assert ask(pts(C.up_down_height), "LINESTRING Z(0 0 1, 1 0 4, 2 0 2)") == {"up": 3.0, "down": 2.0}
    assert ask(pts(lambda p: C.min_distance(at(5, 3), p)), "LINESTRING(0 0, 10 0)") == 3.0
    assert ask(pts(C.clockwise), "LINESTRING(0 0, 0 1, 1 1, 0 0)") is True
