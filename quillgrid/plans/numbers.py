"""Codecs of numbers and coordinates, and box predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, mbr
from ..operators import ranges

EXTENT = (0.0, 0.0, 200000.0, 100.0)
_li = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def _normal(kind: str, column: str, low: float, high: float) -> Callable[[SparkSession, str], DataFrame]:
    def q(s: SparkSession, d: str) -> DataFrame:
        code = codec.encode(F.col(column), kind, low, high)
        return _li(s, d).select("l_orderkey", "l_linenumber", code.alias("code"), F.round(codec.decode(code, kind, low, high), 9).alias("value"))

    return q


def _normal_sql(kind: str, column: str, low: float, high: float) -> str:
    n = codec.UNITS[kind]
    return f"SELECT l_orderkey, l_linenumber, c AS code, round({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * c / {n}.0::DOUBLE, 9) AS value FROM (SELECT *, CAST(trunc({n} * ({column} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)) AS BIGINT) % {n + 1} AS c FROM lineitem)"


def _coords(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(s: SparkSession, d: str) -> DataFrame:
        x0, y0, x1, y1 = EXTENT
        cx, cy = codec.encode(F.col("l_extendedprice"), kind, x0, x1), codec.encode(F.col("l_quantity"), kind, y0, y1)
        return _li(s, d).select("l_orderkey", "l_linenumber", cx.alias("cx"), cy.alias("cy"), F.round(codec.decode(cx, kind, x0, x1), 6).alias("x"), F.round(codec.decode(cy, kind, y0, y1), 6).alias("y"))

    return q


def _coords_sql(kind: str) -> str:
    n = codec.UNITS[kind]
    e = lambda c, hi: f"CAST(least(greatest(trunc({n} * ({c} - 0.0::DOUBLE) / ({hi}::DOUBLE - 0.0::DOUBLE)), 0), {n}) AS BIGINT)"
    return f"SELECT l_orderkey, l_linenumber, cx, cy, round(0.0::DOUBLE + 200000.0::DOUBLE * cx / {n}.0::DOUBLE, 6) AS x, round(0.0::DOUBLE + 100.0::DOUBLE * cy / {n}.0::DOUBLE, 6) AS y FROM (SELECT *, {e('l_extendedprice', 200000.0)} AS cx, {e('l_quantity', 100.0)} AS cy FROM lineitem)"


def f32_coords(s: SparkSession, d: str) -> DataFrame:
    return _li(s, d).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("float").cast("double"), 6).alias("x"))


def int_wrap(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    v = F.col("o_totalprice") * F.lit(-1.5)
    return o.select("o_orderkey", codec.wrapped(F.col("o_orderkey"), 8).alias("u8"), codec.wrapped(v, 16).alias("u16"), codec.wrapped(v, 32).alias("u32"), codec.signed32(v).alias("i32"))


def bbox_quantised(s: SparkSession, d: str) -> DataFrame:
    b = codec.padded_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), EXTENT)
    return _order_boxes(s, d).select("l_orderkey", b.alias("b")).select("l_orderkey", "b.*")


def _order_boxes(s: SparkSession, d: str) -> DataFrame:
    return _li(s, d).groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("x0"), F.min("l_quantity").alias("y0"), F.max("l_extendedprice").alias("x1"), F.max("l_quantity").alias("y1"))


_BOXES_SQL = "(SELECT l_orderkey, min(l_extendedprice) AS x0, min(l_quantity) AS y0, max(l_extendedprice) AS x1, max(l_quantity) AS y1 FROM lineitem GROUP BY 1)"


def bbox_contains(s: SparkSession, d: str) -> DataFrame:
    b = mbr.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return _order_boxes(s, d).select("l_orderkey", mbr.contains_point(b, F.lit(30000.0), F.lit(25.0)).alias("inside"), F.round(mbr.area(b), 4).alias("area"))


def bbox_intersects(s: SparkSession, d: str) -> DataFrame:
    b = mbr.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    w = mbr.box(F.lit(20000.0), F.lit(10.0), F.lit(40000.0), F.lit(30.0))
    return _order_boxes(s, d).select("l_orderkey", mbr.intersects(b, w).alias("closed"), mbr.overlaps_strictly(b, w).alias("strict"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Boxes of customers on a grid of whole numbers, each with that of the customer whose key is one more."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).cast("double").alias("x"), (F.col("c_custkey") % 5).cast("double").alias("y"), (F.col("c_custkey") % 3 + 1).cast("double").alias("w"))
    box = lambda p: mbr.box(F.col(f"{p}.x"), F.col(f"{p}.y"), F.col(f"{p}.x") + F.col(f"{p}.w"), F.col(f"{p}.y") + F.col(f"{p}.w"))
    return c.alias("a").join(c.alias("b"), F.col("b.k") == F.col("a.k") + 1).select(F.col("a.k").alias("k"), box("a").alias("a"), box("b").alias("b"))


_PAIRS_SQL = "(SELECT a.k, a.x AS ax0, a.y AS ay0, a.x + a.w AS ax1, a.y + a.w AS ay1, b.x AS bx0, b.y AS by0, b.x + b.w AS bx1, b.y + b.w AS by1 FROM c a JOIN c b ON b.k = a.k + 1)"
_PAIRS_WITH = "WITH c AS (SELECT c_custkey AS k, CAST(c_custkey % 7 AS DOUBLE) AS x, CAST(c_custkey % 5 AS DOUBLE) AS y, CAST(c_custkey % 3 + 1 AS DOUBLE) AS w FROM customer)"


def mbr_predicates(s: SparkSession, d: str) -> DataFrame:
    named: dict[str, Callable[[Column, Column], Column]] = {"equal": mbr.equal, "disjoint": mbr.disjoint, "touches": mbr.touches_compat, "intersects": mbr.intersects, "overlaps": mbr.overlaps, "contains": mbr.contains, "within": mbr.within}
    return _pairs(s, d).select("k", *[f(F.col("a"), F.col("b")).alias(n) for n, f in named.items()])


def mbr_union(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("k", mbr.union(F.col("a"), F.col("b")).alias("u")).select("k", "u.*")


def rect_clip_box(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("k", mbr.clip(F.col("a"), F.col("b")).alias("u")).select("k", "u.*")


def bbox_join(s: SparkSession, d: str) -> DataFrame:
    """How many customers lie in each supplier's box: the points up to its upper end less those below its lower end, so no
    pair is ever made."""
    b = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") - 200).alias("lo"), (F.col("s_acctbal") + 200).alias("hi"))
    p = s.read.parquet(f"{d}/customer.parquet")
    return ranges.count_within(p, "c_acctbal", b, "s_suppkey", "lo", "hi")


QUERIES = {
    "u8n_roundtrip": _normal("u8n", "l_discount", 0.0, 1.0),
    "u16n_roundtrip": _normal("u16n", "l_tax", 0.0, 1.0),
    **{f"{k}_coords": _coords(k) for k in ("tx16", "tx24", "tx32")},
    **{f.__name__: f for f in (f32_coords, int_wrap, bbox_quantised, bbox_contains, bbox_intersects, mbr_predicates, mbr_union, rect_clip_box, bbox_join)},
}
_q = lambda v, hi: f"CAST(least(greatest(trunc(65535 * (({v}) - 0.0::DOUBLE) / ({hi}::DOUBLE - 0.0::DOUBLE)), 0), 65535) AS BIGINT)"
ORACLE_SQL = {
    "u8n_roundtrip": _normal_sql("u8n", "l_discount", 0.0, 1.0),
    "u16n_roundtrip": _normal_sql("u16n", "l_tax", 0.0, 1.0),
    **{f"{k}_coords": _coords_sql(k) for k in ("tx16", "tx24", "tx32")},
    "f32_coords": "SELECT l_orderkey, l_linenumber, round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 6) AS x FROM lineitem",
    "int_wrap": "SELECT o_orderkey, o_orderkey % 256 AS u8, ((v % 65536) + 65536) % 65536 AS u16, ((v % 4294967296) + 4294967296) % 4294967296 AS u32, CAST(v AS INTEGER) AS i32 FROM (SELECT *, CAST(trunc(o_totalprice * -1.5::DOUBLE) AS BIGINT) AS v FROM orders)",
    "bbox_quantised": f"SELECT l_orderkey, {_q('x0 - 200000.0::DOUBLE / 65535', 200000.0)} AS minx, {_q('y0 - 100.0::DOUBLE / 65535', 100.0)} AS miny, {_q('x1 + 200000.0::DOUBLE / 65535', 200000.0)} AS maxx, {_q('y1 + 100.0::DOUBLE / 65535', 100.0)} AS maxy FROM {_BOXES_SQL}",
    "bbox_contains": f"SELECT l_orderkey, 30000 BETWEEN x0 AND x1 AND 25 BETWEEN y0 AND y1 AS inside, round((x1 - x0) * (y1 - y0), 4) AS area FROM {_BOXES_SQL}",
    "bbox_intersects": f"SELECT l_orderkey, x0 <= 40000 AND 20000 <= x1 AND y0 <= 30 AND 10 <= y1 AS closed, x0 < 40000 AND 20000 < x1 AND y0 < 30 AND 10 < y1 AS strict FROM {_BOXES_SQL}",
    "mbr_predicates": f'{_PAIRS_WITH} SELECT k, ax0 = bx0 AND ay0 = by0 AND ax1 = bx1 AND ay1 = by1 AS "equal", NOT i AS disjoint, ax0 = bx0 OR ay0 = by0 OR ax1 = bx1 OR ay1 = by1 AS touches, i AS intersects, i AND (ax0 BETWEEN bx0 AND bx1 OR ax1 BETWEEN bx0 AND bx1 OR ay0 BETWEEN by0 AND by1 OR ay1 BETWEEN by0 AND by1) AS overlaps, bx0 >= ax0 AND bx1 <= ax1 AND by0 >= ay0 AND by1 <= ay1 AS contains, ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1 AS within FROM (SELECT *, ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 AS i FROM {_PAIRS_SQL})',
    "mbr_union": f"{_PAIRS_WITH} SELECT k, least(ax0, bx0) AS minx, least(ay0, by0) AS miny, greatest(ax1, bx1) AS maxx, greatest(ay1, by1) AS maxy FROM {_PAIRS_SQL}",
    "rect_clip_box": f"{_PAIRS_WITH} SELECT k, CASE WHEN o THEN greatest(ax0, bx0) END AS minx, CASE WHEN o THEN greatest(ay0, by0) END AS miny, CASE WHEN o THEN least(ax1, bx1) END AS maxx, CASE WHEN o THEN least(ay1, by1) END AS maxy FROM (SELECT *, ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1 AS o FROM {_PAIRS_SQL})",
    "bbox_join": "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - 200 AND s_acctbal + 200 GROUP BY 1",
}
