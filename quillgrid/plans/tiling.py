"""Tile selection and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles
from ..operators.tileset import TileSet
from ..store import Block


def _tiles(s: SparkSession, d: str, loaded: bool) -> DataFrame:
    """A tile a supplier: coarse ones are larger; coordinates are whole numbers."""
    t = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS id", "cast(s_suppkey % 4 AS int) AS level", "double(s_suppkey % 3) AS t", "s_suppkey * 7 % 40 AS x", "s_suppkey * 13 % 40 AS y", "32 / pow(2, s_suppkey % 4) AS w")
    on = "true" if loaded else "id % 5 <> 0"
    return t.selectExpr("id", "level", "t", "double(x) AS minx", "double(y) AS miny", "double(x + w) AS maxx", "double(y + w) AS maxy", f"{on} AS loaded")


def _windows(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS window_id", "3 - n_nationkey % 2 AS max_level", "double(n_nationkey) AS minx", "double(n_nationkey * 2 % 30) AS miny", "double(n_nationkey + 6) AS maxx", "double(n_nationkey * 2 % 30 + 5) AS maxy")


def tile_take(s: SparkSession, d: str) -> DataFrame:
    return tiles.take(_tiles(s, d, True), _windows(s, d))


def tile_take_unloaded(s: SparkSession, d: str) -> DataFrame:
    return tiles.take(_tiles(s, d, False), _windows(s, d))


def tile_shrink(s: SparkSession, d: str) -> DataFrame:
    used = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("last_frame"))
    return tiles.shrink(used, 32).select("id", "last_frame")


def tile_draw(s: SparkSession, d: str) -> DataFrame:
    """One window drawn twice: at first nothing is loaded, so every candidate comes; then what that has loaded decides."""
    t = _tiles(s, d, True).withColumn("path", F.concat(F.lit("tile-"), F.col("id").cast("string")))
    found = TileSet(s, t, load=lambda path: Block.of(s, {path: s.range(1)}))
    w = _windows(s, d).where("window_id = 3").first()
    box = (w["minx"], w["miny"], w["maxx"], w["maxy"])
    rows = [(turn, n, i, path) for turn in (1, 2) for n, (i, path, _) in enumerate(found.draw(w["max_level"], box))]
    found.close()
    return s.createDataFrame(rows, "turn int, place int, id long, path string")


QUERIES = {f.__name__: f for f in (tile_take, tile_take_unloaded, tile_shrink, tile_draw)}


def _take_sql(on: str) -> str:
    return f"""WITH {_TAKE.replace("$on", on)}
SELECT s.window_id, CAST(row_number() OVER (PARTITION BY s.window_id ORDER BY s.rank DESC) AS INTEGER) AS draw_order, c.id, c.level FROM s JOIN c ON s.window_id = c.window_id AND s.rank = c.rank"""


_TAKE = """
t AS (SELECT id, level, t, x AS minx, y AS miny, x + w AS maxx, y + w AS maxy, $on AS loaded FROM (SELECT s_suppkey AS id, CAST(s_suppkey % 4 AS INTEGER) AS level, CAST(s_suppkey % 3 AS DOUBLE) AS t, CAST(s_suppkey * 7 % 40 AS DOUBLE) AS x, CAST(s_suppkey * 13 % 40 AS DOUBLE) AS y, 32 / pow(2, s_suppkey % 4) AS w FROM supplier)),
w AS (SELECT n_nationkey AS window_id, 3 - n_nationkey % 2 AS max_level, CAST(n_nationkey AS DOUBLE) AS x0, CAST(n_nationkey * 2 % 30 AS DOUBLE) AS y0, CAST(n_nationkey + 6 AS DOUBLE) AS x1, CAST(n_nationkey * 2 % 30 + 5 AS DOUBLE) AS y1 FROM nation),
c AS (SELECT window_id, id, level, loaded, row_number() OVER (PARTITION BY window_id ORDER BY level DESC, t DESC, (maxx - minx) * (maxy - miny), id) AS rank, minx, miny, maxx, maxy, x0, y0, x1, y1
      FROM t JOIN w ON minx < x1 AND x0 < maxx AND miny < y1 AND y0 < maxy AND level <= max_level),
cell AS (SELECT window_id, x0 + i AS x, y0 + j AS y FROM w, range(6) a(i), range(5) b(j)),
o AS (SELECT cell.window_id, x, y, rank, loaded FROM cell LEFT JOIN c ON c.window_id = cell.window_id AND x >= minx AND x + 1 <= maxx AND y >= miny AND y + 1 <= maxy),
m AS (SELECT window_id, x, y, min(rank) FILTER (loaded) AS m FROM o GROUP BY ALL),
k AS (SELECT window_id, CASE WHEN count(m) = count(*) THEN max(m) END AS stop FROM m GROUP BY 1),
s AS (SELECT DISTINCT o.window_id, o.rank FROM o JOIN m ON o.window_id = m.window_id AND o.x = m.x AND o.y = m.y JOIN k ON k.window_id = o.window_id WHERE rank IS NOT NULL AND (m IS NULL OR m >= rank) AND (stop IS NULL OR rank <= stop))
"""


ORACLE_SQL = {
    "tile_draw": f"""WITH {_TAKE.replace("$on", "true")}
SELECT turn, CAST(row_number() OVER (PARTITION BY turn ORDER BY rank DESC) - 1 AS INTEGER) AS place, CAST(id AS BIGINT) AS id, 'tile-' || id AS path
FROM (SELECT 1 AS turn, rank, id FROM c WHERE window_id = 3 UNION ALL SELECT 2, c.rank, c.id FROM s JOIN c ON s.window_id = c.window_id AND s.rank = c.rank WHERE c.window_id = 3)""",
    "tile_take": _take_sql("true"),
    "tile_take_unloaded": _take_sql("id % 5 <> 0"),
    "tile_shrink": "SELECT id, last_frame FROM (SELECT *, row_number() OVER (ORDER BY last_frame DESC, id) AS n FROM (SELECT user_id AS id, max(event_id) AS last_frame FROM events GROUP BY 1)) WHERE n > 32",
}
