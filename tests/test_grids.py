import math

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import collection as C
from quillgrid.functions import path
from quillgrid.functions import textgeom as G
from quillgrid.operators import grids


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", G.st_from_wkt("t").alias("g"))


def numbers(df, key=0):
    return sorted((r.cell_i, r.cell_j, r.cell_k) for r in df.where(F.col("id") == key).collect())


def test_squares(spark):
    df = grids.cells(frame(spark, "POLYGON((0.5 0.5, 2.5 0.5, 2.5 1.5, 0.5 1.5, 0.5 0.5))", "POINT(1 1)", "LINESTRING(0.5 0.5, 3.5 3.4)", None, "POINT EMPTY"), "g", 1.0).cache()
    assert numbers(df) == [(i, j, 0) for i in range(3) for j in range(2)]
    assert numbers(df, 1) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]  # a corner touches four
    assert numbers(df, 2) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0), (3, 2, 0), (3, 3, 0)]
    assert df.where("id > 2").count() == 0


def test_holes_and_insides(spark):
    text = "POLYGON((0.5 0.5, 9.5 0.5, 9.5 9.5, 0.5 9.5, 0.5 0.5), (2.5 2.5, 7.5 2.5, 7.5 7.5, 2.5 7.5, 2.5 2.5))"
    got = numbers(grids.cells(frame(spark, text), "g", 1.0))
    assert got == [(i, j, 0) for i in range(10) for j in range(10) if not (3 <= i <= 6 and 3 <= j <= 6)]


@pytest.mark.parametrize("shape,area", [("triangle", math.sqrt(3) / 4), ("hexagon", 3 * math.sqrt(3) / 2)])
def test_cells_tile_the_plane(spark, shape, area):
    """Each of many points lies in exactly one cell, and cells have the area of their shape."""
    texts = [f"POINT({x * 0.731 - 3.03} {y * 0.577 - 2.01})" for x in range(8) for y in range(8)]
    got = grids.cells(frame(spark, *texts), "g", 1.0, shape, (0.1, 0.2)).withColumn("a", F.abs(path.signed_area(F.col("cell")))).collect()
    assert sorted(r.id for r in got) == list(range(64)) and all(r.a == pytest.approx(area) for r in got)


def test_modes_and_errors(spark):
    df = grids.cells(frame(spark, "POINT(0.5 0.5)"), "g", 1.0)
    got = df.select(*[G.st_as_wkt(grids.as_geometry(F.col("cell"), m)).alias(m) for m in ("polygon", "edges", "points")]).first()
    assert got.polygon == "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))" and got.points == "MULTIPOINT(0 0, 1 0, 1 1, 0 1)" and got.edges.count("(") == 5
    assert df.select(C.area_of(grids.as_geometry(F.col("cell")))).first()[0] == 1.0
    for bad in (lambda: grids.cells(df, "g", 1.0), lambda: grids.cells(frame(spark, "POINT(1 1)"), "g", 0.0), lambda: grids.cells(frame(spark, "POINT(1 1)"), "g", 1.0, "circle"), lambda: grids.as_geometry(F.lit(1), "x")):
        with pytest.raises(Exception):
            bad()
