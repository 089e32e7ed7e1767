import math
import random

import pytest

from quillgrid.functions import polygon as P
from quillgrid.functions import textgeom as G
from quillgrid.sources import shapefile as S


def box(left, top, right, bottom):
    return [(left, top), (right, top), (right, bottom), (left, bottom)]


def path(text):
    return [tuple(map(int, q.split(","))) for q in text.split()]


def total(rings):
    return sum(map(P.area, rings))


@pytest.mark.parametrize(("op", "area"), [("intersection", 16), ("union", 34), ("difference", 9), ("xor", 18)])
def test_booleans_of_squares(op, area):
    assert total(P.boolean(op, [box(0, 0, 5, 5)], [box(1, 1, 6, 6)])) == area


def test_negative_fill_and_trees():
    got = P.boolean("union", [box(0, 0, 100, 100)[::-1], box(10, 10, 110, 110)[::-1]], [box(50, 50, 150, 150)[::-1]], "negative")
    assert [len(r) for r in got] == [12]
    ring = P.boolean("difference", [box(0, 0, 9, 9)], [box(3, 3, 6, 6)])
    assert sorted((p, h) for _, p, h in P.tree(ring)) == sorted([(-1, False), (next(i for i, r in enumerate(ring) if P.area(r) > 0), True)])


def test_random_booleans_agree_with_winding_numbers():
    rnd = random.Random(42)
    for _ in range(80):
        n = rnd.randint(3, 8)
        s = [[(rnd.randint(0, 40) * 100, rnd.randint(0, 40) * 100) for _ in range(n)] for _ in range(rnd.randint(1, 2))]
        c = [[(rnd.randint(0, 40) * 100, rnd.randint(0, 40) * 100) for _ in range(n)]]
        op, fill = rnd.choice(list(P.OPS)), rnd.choice(list(P.FILL))
        got = P.boolean(op, s, c, fill)
        for _ in range(30):
            q = (rnd.randint(0, 4000) * 7 + 3, rnd.randint(0, 4000) * 7 + 1)
            up = lambda ps: [[(x * 7, y * 7) for x, y in p] for p in ps]
            if min(math.sqrt(P._perp2(q, a, b)) for p in up(s) + up(c) + up(got) for a, b in zip(p, p[1:] + p[:1], strict=True)) > 15:
                want = P.OPS[op](P.FILL[fill](P.winding(q, up(s))), P.FILL[fill](P.winding(q, up(c))))
                assert P.winding(q, up(got)) == int(want)


def test_rect_clip():
    r = (100, 100, 700, 500)
    assert abs(total(P.rect_clip(r, [path("100,100 700,100 700,500 100,500")]))) == 240000
    assert abs(total(P.rect_clip(r, [path("90,90 700,100 700,500 100,500")]))) == 240000
    assert P.rect_clip((390, 290, 410, 310), [path("410,290 500,290 500,310 410,310")]) == []
    assert P.rect_clip((390, 290, 410, 310), [path("430,290 470,330 390,330")]) == []
    assert [len(p) for p in P.rect_clip((54690, 0, 65628, 6000), [path("700000,6000 0,6000 0,5925 700000,5925")])] == [4]
    assert P.rect_clip_lines((0, 0, 10, 10), [[(-5, 5), (20, 5)]]) == [[(0, 5), (10, 5)]]


def test_paths():
    assert len(P.trim_collinear(path("10,10 10,10 50,10 100,10 100,100 10,100 10,10 20,10"))) == 4
    assert len(P.trim_collinear(path("10,10 10,10 100,10 100,100 10,100 10,10 10,10"), True)) == 5
    assert P.simplify(path("0,0 1,1 0,20 0,21 1,40 0,41 0,60 0,61 0,80 1,81 0,100"), 2, False) == [(0, 0), (0, 100)]
    assert P.simplify([(0, 0), (5, 1), (9, 0)], 9) == [(0, 0), (5, 1), (9, 0)]
    assert P.douglas_peucker([(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 4)], 0.5) == [(0, 0), (4, 0), (4, 4)]


@pytest.mark.parametrize(("points", "place"), [("", "Outside"), ("100,10 200,10", "Outside"), ("100,10 200,10 10,10 20,20", "On"), ("10,10", "Outside"), ("100,10 110,20 200,10 20,20", "Outside"), ("200,0 0,0 10,20 200,0 20,0", "Inside"), ("0,0 20,20 100,0", "On")])
def test_point_in_polygon(points, place):
    assert P.locate((10, 10), path(points)) == place


def test_offsets():
    grown = P.inflate([path("0,0 0,5 5,5 5,0")], 1, "round")
    assert len(grown) == 1 and P.area(grown[0]) < 0
    assert P.inflate([box(0, 0, 12, 12)], -50, "miter") == []
    assert abs(total(P.inflate([path("0,0 0,10 10,0")], 2, "miter"))) == 122
    assert abs(total(P.inflate([path("0,0 0,10 10,0"), [(5, 5)]], 2, "miter"))) == 122
    assert total(P.inflate([box(0, 0, 100, 100)], 10, "miter")) == 14400
    assert total(P.inflate([[(0, 0), (100, 0)]], 10, "miter", "square")) == 2400
    assert total(P.minkowski(box(-1, -1, 1, 1), box(0, 0, 10, 10), True)) == 80


@pytest.mark.parametrize("text", ["POINT(1 2)", "POINT Z(1 2 3)", "LINESTRING(0 0, 1.5 2)", "POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT(1 2, 3 4)", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))", "POINT EMPTY", "SRID=4326;POINT M(1 2 3)"])
def test_text_round_trips(text):
    g = G.from_wkt(text)
    assert G.to_wkt(g, True) == text
    assert G.from_wkb(G.to_wkb(g, False, True)) == g
    if g.kind != "GeometryCollection":
        assert G.of_struct(G.as_struct(g)) == g


def test_broken_geometry_is_null(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("POINT(1",), ("nonsense",), (None,), ("POINT(1 2)",)], "t string").select(G.st_as_geojson(G.st_from_wkt(F.col("t"))).alias("g")).collect()
    assert [r["g"] for r in rows] == [None, None, None, '{"type":"Point","coordinates":[1.0,2.0]}']
    with pytest.raises(ValueError):
        G.from_wkb(b"\x01\x01\x00")


def test_shapefile_round_trip(spark, tmp_path):
    g = G.from_wkt("POLYGON((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 1))")
    assert S.read_shapes(S.write_shapes([g, None])[0]) == [g, None]
    df = spark.createDataFrame([(G.as_struct(g), "ü", 5, 1.5, True), (None, "b", -3, 0.25, False)], f"geom {G.GEOM}, name string, n int, v double, f boolean")
    for ext, raw in S.shapefile_bytes(df).items():
        (tmp_path / f"a.{ext}").write_bytes(raw)
    got = S.read_shapefile(spark, str(tmp_path / "a.shp")).orderBy("row").collect()
    assert [(r["name"], r["n"], r["v"], r["f"]) for r in got] == [("ü", 5, 1.5, True), ("b", -3, 0.25, False)]
    assert got[1]["geom"] is None and len(got[0]["geom"]["parts"]) == 2


def test_null_and_empty_paths(spark):
    """Columns are read a column of numbers at a time: nulls, empty rows and empty paths keep their places."""
    from pyspark.sql import functions as F

    from quillgrid.functions import geometry

    square = [[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    df = spark.createDataFrame([(0, square), (1, None), (2, []), (3, [[]]), (4, square + [[]] + square)], f"k int, p {geometry.PATHS}").coalesce(1)
    none = F.array().cast(geometry.PATHS)
    rows = df.where("k > 0").union(df.where("k = 0")).select("k", geometry.boolean("union", F.col("p"), none).alias("u"), geometry.boolean("xor", none, F.col("p")).alias("v")).orderBy("k").collect()
    size = lambda n: [r[n] and len(r[n]) for r in rows]
    assert size("u") == [1, None, [], [], 1] and size("v") == size("u")


def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    """One task would read the file, however long each row takes."""
    from pyspark.sql import functions as F

    from quillgrid import catalog

    spark.range(2500).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(60_000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("s").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("polygon_fills", "offset_joins", "polygon_lines", "polygon_tree", "text_formats", "blob_roundtrip"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3, name
