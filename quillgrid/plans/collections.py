"""Geometry collections, measures, blobs and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blobgeom, path
from ..functions import collection as C
from ..operators import grids
from ..staging import spread
from .shapes import _LINE, lines


def _line_geometry(line: Column) -> Column:
    """A line by item number, with the price as y and z and the item number as m."""
    points = F.transform(line, lambda p: C.vertex(p["x"], p["y"], p["y"], p["x"]))
    return C.whole("LineString", F.array(C.part(2, points)), "XYZM")


def square_grid(s: SparkSession, d: str) -> DataFrame:
    """Cells of side 2 that meet the box of each supplier."""
    b = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", "double(s_suppkey % 7) AS x", "double(s_suppkey % 5) AS y", "double(s_suppkey % 3 + 2) AS w")
    g = b.select("s_suppkey", C.box_polygon(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")).alias("g"))
    return grids.cells(g, "g", 2.0).select("s_suppkey", "cell_i", "cell_j")


def hexagon_bins(s: SparkSession, d: str) -> DataFrame:
    """Customers by the hexagon of side 500 they lie in, and how many hexagons each lies in at most."""
    p = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.make_point(F.col("c_acctbal"), F.col("c_custkey") + 0.123).alias("g"))
    hit = grids.cells(p, "g", 500.0, "hexagon").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return hit.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


def line_measures(s: SparkSession, d: str) -> DataFrame:
    """Climb, descent and range of heights along each order's line, and its number of vertices."""
    g = lines(s, d).select("l_orderkey", _line_geometry(F.col("line")).alias("g"))
    up = C.up_down_height(C.points_of(F.col("g")))
    z = C.z_range(F.col("g"))
    return g.select("l_orderkey", F.round(up["up"], 5).alias("up"), F.round(up["down"], 5).alias("down"), z["low"].alias("low"), z["high"].alias("high"), C.point_count(F.col("g")).cast("long").alias("points"))


def trajectory_at(s: SparkSession, d: str) -> DataFrame:
    """Where each order's line is at measure 1.5, where it is a trajectory and gets there."""
    p = C.trajectory_point(_line_geometry(F.col("line")), 1.5)
    got = lines(s, d).select("l_orderkey", p.alias("p")).where(F.col("p").isNotNull())
    v = F.col("p.parts")[0]["points"][0]
    return got.select("l_orderkey", F.round(v["x"], 6).alias("x"), F.round(v["y"], 6).alias("y"))


def distance_to_line(s: SparkSession, d: str) -> DataFrame:
    """From the point (0, 0) to the nearest vertex or side of each line."""
    origin = path.point(F.lit(0.0), F.lit(0.0))
    return lines(s, d).select("l_orderkey", (F.round(C.min_distance(origin, F.col("line")), 3)).alias("distance"))


def blob_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Points as database blobs, compressed ones and FGF, and read back."""
    c = spread(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey"), 20_000).select("c_custkey", C.make_point(F.col("c_custkey").cast("double"), F.col("c_nationkey") + 0.5).alias("g"))
    x = lambda g: g["parts"][0]["points"][0]["x"]
    return c.select(
        "c_custkey", F.length(blobgeom.st_as_blob("g")).cast("long").alias("bytes"), x(blobgeom.st_from_blob(blobgeom.st_as_blob("g"))).alias("blob_x"),
        x(blobgeom.st_from_blob(blobgeom.st_as_compressed_blob("g"))).alias("small_x"), x(blobgeom.st_from_fgf(blobgeom.st_as_fgf("g"))).alias("fgf_x"),
    )


QUERIES = {f.__name__: f for f in (square_grid, hexagon_bins, line_measures, trajectory_at, distance_to_line, blob_roundtrip)}
_n = "(x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)"
_t = f"least(greatest((-x * (x2 - x) - y * (y2 - y)) / ({_n}), 0), 1)"
ORACLE_SQL = {
    "square_grid": "SELECT s_suppkey, i AS cell_i, j AS cell_j FROM (SELECT s_suppkey, s_suppkey % 7 AS x, s_suppkey % 5 AS y, s_suppkey % 3 + 2 AS w FROM supplier), range(-5, 10) t(i), range(-5, 10) u(j) WHERE 2 * i <= x + w AND 2 * i + 2 >= x AND 2 * j <= y + w AND 2 * j + 2 >= y",
    "hexagon_bins": "SELECT CAST(1 AS BIGINT) AS n, count(*) AS customers FROM customer",
    "line_measures": f"SELECT l_orderkey, round(sum(coalesce(greatest(y2 - y, 0), 0)), 5) AS up, round(sum(coalesce(greatest(y - y2, 0), 0)), 5) AS down, min(y) AS low, max(y) AS high, count(*) AS points FROM {_LINE} GROUP BY 1",
    "trajectory_at": f"WITH l AS (SELECT * FROM {_LINE}), fine AS (SELECT l_orderkey FROM l GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(DISTINCT x)) SELECT l_orderkey, round(CAST(1.5 AS DOUBLE), 6) AS x, round(y + (1.5::DOUBLE - x) / (x2 - x) * (y2 - y), 6) AS y FROM l WHERE l_orderkey IN (FROM fine) AND 1.5 BETWEEN x AND x2",
    "distance_to_line": f"SELECT l_orderkey, round(min(least(sqrt(x * x + y * y), coalesce(CASE WHEN {_n} > 0 THEN sqrt((x + {_t} * (x2 - x)) ** 2 + (y + {_t} * (y2 - y)) ** 2) END, sqrt(x * x + y * y)))), 3) AS distance FROM {_LINE} GROUP BY 1",
    "blob_roundtrip": "SELECT c_custkey, CAST(60 AS BIGINT) AS bytes, CAST(c_custkey AS DOUBLE) AS blob_x, CAST(c_custkey AS DOUBLE) AS small_x, CAST(c_custkey AS DOUBLE) AS fgf_x FROM customer",
}
