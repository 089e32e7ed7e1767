"""Paths, rings, polygons, text codecs and the container."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, path, textgeom
from ..sources import container
from ..staging import shared_path, spread
from ..store import Block, with_fid
from ..types import BY_NAME, field


def rings(s: SparkSession, d: str) -> DataFrame:
    """vec_id and a ring of 32 points out of each embedding, on a grid of hundredths."""
    e = s.read.parquet(f"{d}/embeddings.parquet")
    flat = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000) / 10)
    return e.select("vec_id", path.of_flat(flat).alias("ring"))


_RINGS = "r AS (SELECT vec_id, list_transform(range(1, 33), lambda i: {'x': round(CAST(embedding[2 * i - 1] AS DOUBLE) * 1000) / 10, 'y': round(CAST(embedding[2 * i] AS DOUBLE) * 1000) / 10}) AS ring FROM embeddings)"
_SIDES = f"WITH {_RINGS}, e AS (SELECT vec_id, i, ring[i] AS a, ring[i % 32 + 1] AS b FROM r, range(1, 33) t(i))"


def lines(s: SparkSession, d: str) -> DataFrame:
    """l_orderkey and the line of its items, by number."""
    li = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("x"), F.col("l_extendedprice").alias("y")))).alias("line"))
    return li  # an order has few items


_LINE = "(SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS x, l_extendedprice AS y, lead(CAST(l_linenumber AS DOUBLE)) OVER w AS x2, lead(l_extendedprice) OVER w AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice))"


def line_length(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).select("l_orderkey", F.round(path.length(F.col("line")), 3).alias("length"))


def line_bounds(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).select("l_orderkey", path.bounds(F.col("line")).alias("b"), F.size("line").cast("long").alias("points")).select("l_orderkey", "b.*", "points")


def dissolve_segments(s: SparkSession, d: str) -> DataFrame:
    g = lines(s, d).select("l_orderkey", F.explode(path.segments(F.col("line"))).alias("s"))
    return g.select("l_orderkey", F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def extract_points(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).select("l_orderkey", F.posexplode("line").alias("i", "p")).select("l_orderkey", F.col("i").cast("long").alias("i"), "p.x", "p.y")


def ring_area(s: SparkSession, d: str) -> DataFrame:
    return rings(s, d).select("vec_id", F.round(path.signed_area(F.col("ring")), 4).alias("area"), path.is_positive(F.col("ring")).alias("positive"), F.round(path.length(F.col("ring"), True), 4).alias("perimeter"))


def ring_centroid(s: SparkSession, d: str) -> DataFrame:
    c = rings(s, d).where(F.abs(path.signed_area(F.col("ring"))) > 1).select("vec_id", path.centroid(F.col("ring")).alias("c"), path.centroid_compat(F.col("ring")).alias("k"))
    r = lambda x: F.round(x, 4)
    return c.select("vec_id", r("c.x").alias("x"), r("c.y").alias("y"), r("k.x").alias("abs_x"), r("k.y").alias("abs_y"))


def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    probe = F.explode(F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(v).alias("x"), F.lit(w).alias("y")) for i, (v, w) in enumerate([(0.05, 0.03), (5.13, -4.77), (-20.01, 11.03), (300.0, 0.0)])])).alias("p")
    return rings(s, d).select("vec_id", "ring", probe).select("vec_id", F.col("p.i").cast("int").alias("i"), path.point_in_ring(F.col("p.x"), F.col("p.y"), F.col("ring")).alias("place"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    """Four points of each ring, as whole numbers."""
    p = lambda i: path.point(F.round(F.col("ring")[i]["x"]), F.round(F.col("ring")[i]["y"]))
    return rings(s, d).select("vec_id", p(0).alias("a"), p(1).alias("b"), p(2).alias("c"), p(3).alias("d"))


_STEPS = f"WITH {_RINGS}, s AS (SELECT vec_id, round(ring[1].x) AS ax, round(ring[1].y) AS ay, round(ring[2].x) AS bx, round(ring[2].y) AS \"by\", round(ring[3].x) AS cx, round(ring[3].y) AS cy, round(ring[4].x) AS dx, round(ring[4].y) AS dy FROM r)"


def closest_point(s: SparkSession, d: str) -> DataFrame:
    q = path.closest_on_segment(F.col("c"), F.col("a"), F.col("b"))
    return _steps(s, d).select("vec_id", (F.round(q["x"], 6) + 0.0).alias("x"), (F.round(q["y"], 6) + 0.0).alias("y"), F.round(path.perpendicular_squared(F.col("c"), F.col("a"), F.col("b")), 4).alias("perp2"), F.round(path.distance(F.col("a"), F.col("b")), 6).alias("dist"))


def segment_intersect(s: SparkSession, d: str) -> DataFrame:
    a, b, c, e = (F.col(k) for k in "abcd")
    q = path.intersection(a, b, c, e)
    return _steps(s, d).select("vec_id", path.segments_cross(a, b, c, e).alias("crosses"), path.is_collinear(a, b, c).alias("collinear"), (F.round(q["x"], 5) + 0.0).alias("x"), (F.round(q["y"], 5) + 0.0).alias("y"))


def strip_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Rings snapped to a coarse grid, without repeated points."""
    r = F.transform(F.col("ring"), lambda p: path.point(F.floor(p["x"] / 200), F.floor(p["y"] / 200)))
    return rings(s, d).select("vec_id", F.size(path.strip_duplicates(r)).cast("long").alias("n_open"), F.size(path.strip_duplicates(r, True)).cast("long").alias("n_closed"))


def transform_path(s: SparkSession, d: str) -> DataFrame:
    r = path.scale(path.translate(F.col("ring"), 10.5, -3.0), 2.0, 0.5)
    return rings(s, d).select("vec_id", F.posexplode(r).alias("i", "p")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def ellipse_points(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/region.parquet")
    e = path.ellipse(F.col("r_regionkey").cast("double"), F.lit(0.0), 8.0, 4.0, 12)
    return r.select("r_regionkey", F.posexplode(e).alias("i", "p")).select("r_regionkey", F.col("i").cast("long").alias("i"), (F.round("p.x", 8) + 0.0).alias("x"), F.round(F.col("p.y") + 100, 8).alias("y"))


def wkt_write(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    x, y = F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double") + 0.5
    return c.select("c_custkey", textgeom.point_wkt(x, y).alias("wkt"), textgeom.point_geojson(x, y).alias("geojson"))


def wkt_read(s: SparkSession, d: str) -> DataFrame:
    g = textgeom.st_from_wkt(F.col("wkt"))
    p = wkt_write(s, d).select("c_custkey", g.alias("g"))
    return p.select("c_custkey", F.col("g.kind").alias("kind"), F.col("g.parts")[0]["points"][0]["x"].alias("x"), F.col("g.parts")[0]["points"][0]["y"].alias("y"))


def wkb_roundtrip(s: SparkSession, d: str) -> DataFrame:
    g = textgeom.st_from_wkt(textgeom.line_wkt(F.col("line")))
    back = textgeom.st_as_wkt(textgeom.st_from_wkb(textgeom.st_as_wkb(g)))
    return lines(s, d).where(F.size("line") > 1).select("l_orderkey", textgeom.line_wkt(F.col("line")).alias("wkt"), back.alias("back")).select("l_orderkey", (F.regexp_replace("wkt", r"\.0\b", "") == F.regexp_replace("back", r"\.0\b", "")).alias("same"))


_BOX = "array(struct(double({0}) AS x, double({1}) AS y), struct(double({2}) AS x, double({1}) AS y), struct(double({2}) AS x, double({3}) AS y), struct(double({0}) AS x, double({3}) AS y))"


def _box_pairs(s: SparkSession, d: str) -> DataFrame:
    c = spread(s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), 1000).selectExpr("s_suppkey AS k", "s_suppkey % 7 AS x", "s_suppkey % 5 AS y", "s_suppkey % 3 + 2 AS w", "s_suppkey % 4 AS u", "s_suppkey % 6 AS v")
    return c.selectExpr("k", "x", "y", "w", "u", "v", f"array({_BOX.format('x', 'y', 'x + w', 'y + w')}) AS a", f"array({_BOX.format('u', 'v', 'u + 3', 'v + 3')}) AS b")


def polygon_boolean_area(s: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, p: acc + path.signed_area(p)), 4)
    return _box_pairs(s, d).select("k", *[geometry.boolean(op, F.col("a"), F.col("b")).alias(op) for op in ("intersection", "union", "difference", "xor")]).select("k", *[total(F.col(op)).alias(op) for op in ("intersection", "union", "difference", "xor")])


def offset_area(s: SparkSession, d: str) -> DataFrame:
    a = F.aggregate(geometry.inflate(F.col("a"), 1.0, "miter"), F.lit(0.0), lambda acc, p: acc + path.signed_area(p))
    return _box_pairs(s, d).select("k", F.round(a, 4).alias("area"))


def minkowski_area(s: SparkSession, d: str) -> DataFrame:
    pat = F.expr(_BOX.format(-0.5, -0.5, 0.5, 0.5))
    a = F.aggregate(geometry.minkowski(pat, F.col("a")[0]), F.lit(0.0), lambda acc, p: acc + path.signed_area(p))
    return _box_pairs(s, d).select("k", F.round(a, 4).alias("area"))


def rect_clip(s: SparkSession, d: str) -> DataFrame:
    box = F.struct(F.col("u").cast("double").alias("minx"), F.col("v").cast("double").alias("miny"), (F.col("u") + 3).cast("double").alias("maxx"), (F.col("v") + 3).cast("double").alias("maxy"))
    a = F.aggregate(geometry.rect_clip(box, F.col("a")), F.lit(0.0), lambda acc, p: acc + F.abs(path.signed_area(p)))
    return _box_pairs(s, d).select("k", F.round(a, 4).alias("area"))


def simplify_rdp(s: SparkSession, d: str) -> DataFrame:
    r = F.array("ring")
    return rings(s, d).select("vec_id", F.size(geometry.simplify(r, 20.0)[0]).alias("simplified"), F.size(geometry.douglas_peucker(r, 20.0)[0]).alias("peucker"), F.size(geometry.trim_collinear(r)[0]).alias("trimmed"))


def container_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Nations and suppliers through one container: written to the shared folder, and read from there."""
    layers = {}
    for t, cols in (("nation", (("n_nationkey", "i32"), ("n_name", "str"), ("n_regionkey", "u8"))), ("supplier", (("s_suppkey", "u32"), ("s_name", "wstr"), ("s_nationkey", "u16"), ("s_acctbal", "f64")))):
        rows = with_fid(s.read.parquet(f"{d}/{t}.parquet"), cols[0][0])
        layers[t] = rows.select("_fid", *[F.col(n).cast(BY_NAME[k].spark).alias(n, metadata=field(n, k).metadata) for n, k in cols])
    where = shared_path(s, "container")
    container.save(Block.of(s, layers), where)
    back = container.load(s, where)
    nations = back["nation"].df.select("_fid", F.lit("nation").alias("layer"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("value"))
    return nations.unionByName(back["supplier"].df.select("_fid", F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), (F.col("s_acctbal") + F.col("s_nationkey")).alias("value")))


QUERIES = {f.__name__: f for f in (line_length, line_bounds, dissolve_segments, extract_points, ring_area, ring_centroid, point_in_polygon, closest_point, segment_intersect, strip_duplicates, transform_path, ellipse_points, wkt_write, wkt_read, wkb_roundtrip, polygon_boolean_area, offset_area, minkowski_area, rect_clip, simplify_rdp, container_roundtrip)}
_cross = "(a.x * b.y - b.x * a.y)"
_ov = "greatest(least(x + w, u + 3) - greatest(x, u), 0) * greatest(least(y + w, v + 3) - greatest(y, v), 0)"
_sup = "(SELECT s_suppkey AS k, s_suppkey % 7 AS x, s_suppkey % 5 AS y, s_suppkey % 3 + 2 AS w, s_suppkey % 4 AS u, s_suppkey % 6 AS v FROM supplier)"
_t = "CASE WHEN n = 0 THEN 0 ELSE least(greatest(((cx - ax) * (bx - ax) + (cy - ay) * (\"by\" - ay)) / n, 0), 1) END"
ORACLE_SQL = {
    "line_length": f"SELECT l_orderkey, round(sum(coalesce(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0)), 3) AS length FROM {_LINE} GROUP BY 1",
    "line_bounds": "SELECT l_orderkey, CAST(min(l_linenumber) AS DOUBLE) AS minx, min(l_extendedprice) AS miny, CAST(max(l_linenumber) AS DOUBLE) AS maxx, max(l_extendedprice) AS maxy, count(*) AS points FROM lineitem GROUP BY 1",
    "dissolve_segments": f"SELECT * FROM {_LINE} WHERE x2 IS NOT NULL",
    "extract_points": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS i, CAST(l_linenumber AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem",
    "ring_area": f"{_SIDES} SELECT vec_id, round(sum({_cross} ORDER BY i) / 2, 4) AS area, sum({_cross} ORDER BY i) / 2 >= 0 AS positive, round(sum(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) ORDER BY i), 4) AS perimeter FROM e GROUP BY 1",
    "ring_centroid": f"{_SIDES}, c AS (SELECT vec_id, sum({_cross} ORDER BY i) * 3 AS six, sum((a.x + b.x) * {_cross} ORDER BY i) AS sx, sum((a.y + b.y) * {_cross} ORDER BY i) AS sy FROM e GROUP BY 1) SELECT vec_id, round(sx / six, 4) AS x, round(sy / six, 4) AS y, round(abs(sx / six), 4) AS abs_x, round(abs(sy / six), 4) AS abs_y FROM c WHERE abs(six / 6) > 1",
    "point_in_polygon": f"{_SIDES}, p(i2, px, py) AS (VALUES (0, 0.05::DOUBLE, 0.03::DOUBLE), (1, 5.13, -4.77), (2, -20.01, 11.03), (3, 300.0, 0.0)) SELECT vec_id, i2 AS i, CASE WHEN bool_or((b.x - a.x) * (py - a.y) = (b.y - a.y) * (px - a.x) AND px BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND py BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)) THEN 'On' WHEN count(*) FILTER (a.y <> b.y AND (a.y > py) <> (b.y > py) AND px < (b.x - a.x) * (py - a.y) / (b.y - a.y) + a.x) % 2 = 1 THEN 'Inside' ELSE 'Outside' END AS place FROM e, p GROUP BY 1, 2",
    "closest_point": f'{_STEPS}, q AS (SELECT *, {_t} AS t FROM (SELECT *, (bx - ax) ** 2 + ("by" - ay) ** 2 AS n FROM s)) SELECT vec_id, round(ax + t * (bx - ax), 6) + 0.0::DOUBLE AS x, round(ay + t * ("by" - ay), 6) + 0.0::DOUBLE AS y, round(CASE WHEN n = 0 THEN 0 ELSE ((cx - ax) * ("by" - ay) - (cy - ay) * (bx - ax)) ** 2 / n END, 4) AS perp2, round(sqrt(n), 6) AS dist FROM q',
    "segment_intersect": f"""{_STEPS}, q AS (SELECT *, bx - ax AS dx1, "by" - ay AS dy1, dx - cx AS dx2, dy - cy AS dy2,
 sign((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) AS s1, sign((cx - bx) * (dy - cy) - (cy - "by") * (dx - cx)) AS s2,
 sign((ax - cx) * ("by" - ay) - (ay - cy) * (bx - ax)) AS s3, sign((ax - dx) * ("by" - ay) - (ay - dy) * (bx - ax)) AS s4 FROM s),
 z AS (SELECT *, dy1 * dx2 - dy2 * dx1 AS det, CASE WHEN dy1 * dx2 - dy2 * dx1 <> 0 THEN least(greatest(((ax - cx) * dy2 - (ay - cy) * dx2) / (dy1 * dx2 - dy2 * dx1), 0), 1) END AS t FROM q)
 SELECT vec_id, s1 * s2 < 0 AND s3 * s4 < 0 AS crosses, dx1 * (cy - "by") = dy1 * (cx - bx) AS collinear, round(ax + t * dx1, 5) + 0.0::DOUBLE AS x, round(ay + t * dy1, 5) + 0.0::DOUBLE AS y FROM z""",
    "strip_duplicates": f"WITH {_RINGS}, g AS (SELECT vec_id, i, floor(ring[i].x / 200) AS x, floor(ring[i].y / 200) AS y FROM r, range(1, 33) t(i)), k AS (SELECT *, i = 1 OR x <> lag(x) OVER w OR y <> lag(y) OVER w AS keep FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY i)), n AS (SELECT vec_id, count(*) AS n, arg_min(x, i) = arg_max(x, i) AND arg_min(y, i) = arg_max(y, i) AS same FROM k WHERE keep GROUP BY 1) SELECT vec_id, n AS n_open, CASE WHEN n > 1 AND same THEN n - 1 ELSE n END AS n_closed FROM n",
    "transform_path": f"WITH {_RINGS} SELECT vec_id, i - 1 AS i, round((ring[i].x + 10.5::DOUBLE) * 2, 6) AS x, round((ring[i].y - 3) * 0.5::DOUBLE, 6) AS y FROM r, range(1, 33) t(i)",
    "ellipse_points": "SELECT r_regionkey, i, round(r_regionkey + 8 * cos(i * 2 * pi() / 12), 8) + 0.0::DOUBLE AS x, round(4 * sin(i * 2 * pi() / 12) + 100, 8) AS y FROM region, range(12) t(i)",
    "wkt_write": "SELECT c_custkey, 'POINT(' || c_custkey || ' ' || c_nationkey || '.5)' AS wkt, '{\"type\":\"Point\",\"coordinates\":[' || c_custkey || ',' || c_nationkey || '.5]}' AS geojson FROM customer",
    "wkt_read": "SELECT c_custkey, 'Point' AS kind, CAST(c_custkey AS DOUBLE) AS x, c_nationkey + 0.5::DOUBLE AS y FROM customer",
    "wkb_roundtrip": "SELECT l_orderkey, true AS same FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "polygon_boolean_area": f'SELECT k, CAST(i AS DOUBLE) AS intersection, CAST(w * w + 9 - i AS DOUBLE) AS "union", CAST(w * w - i AS DOUBLE) AS difference, CAST(w * w + 9 - 2 * i AS DOUBLE) AS xor FROM (SELECT *, {_ov} AS i FROM {_sup})',
    "offset_area": f"SELECT k, CAST((w + 2) * (w + 2) AS DOUBLE) AS area FROM {_sup}",
    "minkowski_area": f"SELECT k, CAST((w + 1) * (w + 1) - (w - 1) * (w - 1) AS DOUBLE) AS area FROM {_sup}",
    "rect_clip": f"SELECT k, CAST({_ov} AS DOUBLE) AS area FROM {_sup}",
    "container_roundtrip": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _fid, 'nation' AS layer, CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS DOUBLE) AS value FROM nation UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, 'supplier', s_suppkey, s_name, s_acctbal + s_nationkey FROM supplier",
}
