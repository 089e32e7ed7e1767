"""Layers: scans, lookups, references, bulk building, updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..staging import shared_path
from ..store import Block, dereference, with_defaults, with_fid
from ..types import FID, Feature, field


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


class Spot(Feature):
    x: "f64"  # noqa: F821
    y: "f64"  # noqa: F821
    name: "str"  # noqa: F821


class Money(Feature):
    amount: "f64"  # noqa: F821
    status: "str"  # noqa: F821


class Purchase(Feature):
    number: "u32"  # noqa: F821
    total: Money
    paid: Money


def _rows(s: SparkSession, rows: list[Row], like: DataFrame) -> DataFrame:
    """Rows that a lookup gave, as a table again."""
    return s.createDataFrame([r for r in rows if r is not None], like.schema)


def layer_scan(s: SparkSession, d: str) -> DataFrame:
    """All orders, numbered by key."""
    return with_fid(_t(s, d, "orders"), "o_orderkey")


def layer_scan_wide(s: SparkSession, d: str) -> DataFrame:
    """Documents with their whole texts, numbered by id."""
    return with_fid(_t(s, d, "documents"), "doc_id")


def layer_scan_ties(s: SparkSession, d: str) -> DataFrame:
    """Line items numbered by order and line, of which some tie: each number once, in order."""
    rows = with_fid(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), F.desc("l_orderkey"), "l_linenumber")
    return rows.select(FID, "l_orderkey", "l_linenumber")


def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """Rows 17 and 4711 of the orders, and one that is not there."""
    layer = Block.of(s, {"orders": with_fid(_t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")})["orders"]
    return _rows(s, [layer.get(17), layer.get(4711), layer.get(1 << 40)], layer.df)


def name_lookup(s: SparkSession, d: str) -> DataFrame:
    """Nations pushed one by one under their names; of rows with one name, the first is found, and none for a name not given."""
    block = Block.create(s)
    nations = _t(s, d, "nation").orderBy("n_nationkey").collect()  # a block is built in the driver, row by row
    for r in [*nations, *nations]:
        block.push(Spot(x=float(r["n_nationkey"]), y=float(r["n_regionkey"]), name=r["n_name"].lower()), "nations", name=r["n_name"])
    block.fix()
    return _rows(s, [block.get("FRANCE"), block.get("CHINA"), block.get("france")], block["nations"].df)


def _orders(s: SparkSession, d: str) -> DataFrame:
    ref = F.struct(F.lit(0).alias("ilayer"), F.col("o_custkey").cast("long").alias("ifeature"))
    return _t(s, d, "orders").select("o_orderkey", "o_totalprice", ref.alias("customer"))


def _customers(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "customer").select(F.col("c_custkey").cast("long").alias(FID), "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("long").alias("nation"))


def ref_deref(s: SparkSession, d: str) -> DataFrame:
    return dereference(_orders(s, d), "customer", _customers(s, d), "c_").select("o_orderkey", F.col("c_c_mktsegment").alias("segment"), F.col("c_c_acctbal").alias("acctbal"))


def ref_chain(s: SparkSession, d: str) -> DataFrame:
    """lineitem -> orders -> customer -> nation, then counts a nation: aggregation combines before it shuffles."""
    li = _t(s, d, "lineitem").select(F.struct(F.lit(1).alias("ilayer"), F.col("l_orderkey").cast("long").alias("ifeature")).alias("o"))
    o = _t(s, d, "orders").select(F.col("o_orderkey").cast("long").alias(FID), F.struct(F.lit(2).alias("ilayer"), F.col("o_custkey").cast("long").alias("ifeature")).alias("c"))
    c = _t(s, d, "customer").select(F.col("c_custkey").cast("long").alias(FID), F.struct(F.lit(3).alias("ilayer"), F.col("c_nationkey").cast("long").alias("ifeature")).alias("n"))
    n = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias(FID), "n_name")
    chain = dereference(dereference(dereference(li, "o", o, "o_"), "o_c", c, "c_"), "c_n", n, "n_")
    return chain.groupBy(F.col("n_n_name").alias("nation")).agg(F.count("*").alias("n"))


def ref_dangling(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("event_id", F.struct(F.lit(0).alias("ilayer"), F.col("user_id").cast("long").alias("ifeature")).alias("user"))
    return dereference(e, "user", _customers(s, d), "c_").select("event_id", F.col("c_c_mktsegment").alias("segment"), F.col(f"c_{FID}").isNull().alias("dangling"))


def push_children(s: SparkSession, d: str) -> DataFrame:
    """Each order is a parent with two children of its own, of one class: their references, and what they lead to."""
    o = _t(s, d, "orders").select(F.col("o_orderkey").alias("number"), F.struct(F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")).alias("total"))
    block = Block.push_all(s, Purchase, o, "number")
    child = block["Money"].df
    both = dereference(dereference(block["Purchase"].df, "total", child, "t_", block["Money"].index), "paid", child, "p_", block["Money"].index)
    return both.select(FID, "number", F.col("total.ifeature").alias("total"), F.col("paid.ifeature").alias("paid"), "t_amount", "t_status", "p_amount", "p_status")


def truncate_block(s: SparkSession, d: str) -> DataFrame:
    """As many default rows as there are nations, each with two default children."""
    block = Block.truncate(s, [(Spot, 3, "spots"), (Purchase, _t(s, d, "nation").count(), "purchases")])
    children = block["Money"].df.select(FID, F.lit("Money").alias("layer"), F.col("amount").alias("x"), F.col("status").alias("name"), F.lit(-1).cast("long").alias("ref"))
    spots = block["spots"].df.select(FID, F.lit("spots").alias("layer"), "x", "name", F.lit(-1).cast("long").alias("ref"))
    parents = block["purchases"].df.select(FID, F.lit("purchases").alias("layer"), F.col("number").cast("double").alias("x"), F.lit("").alias("name"), F.col("paid.ifeature").alias("ref"))
    return children.unionByName(spots).unionByName(parents)


_PLACES = {"customer": ("c_custkey", "c_acctbal"), "part": ("p_partkey", "p_retailprice"), "supplier": ("s_suppkey", "s_acctbal"), "orders": ("o_orderkey", "o_totalprice"), "lineitem": ("l_orderkey", "l_extendedprice"), "events": ("event_id", "value")}


def layer_stats(s: SparkSession, d: str) -> DataFrame:
    """Of each layer: its number, rows and extent."""
    block = Block.of(s, {t: _t(s, d, t).select(*xy) for t, xy in _PLACES.items()})
    out = [x.extent(*_PLACES[x.name]).select(F.lit(x.name).alias("layer"), F.lit(x.index).alias("i"), F.lit(len(x)).cast("long").alias("n"), *[F.col(c).cast("double") for c in ("minx", "miny", "maxx", "maxy")]) for x in block.layers.values()]
    return reduce(DataFrame.unionByName, out)


def column_update(s: SparkSession, d: str) -> DataFrame:
    """A column written as a whole; the block that it was written in keeps the rest."""
    block = Block.of(s, {"lineitem": _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "region": _t(s, d, "region")})
    li = block.update_column("lineitem", "l_quantity", F.col("l_quantity") + 1)["lineitem"].df
    return li.groupBy("l_linenumber").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count("*").alias("n"))


def _part_block(s: SparkSession, d: str) -> Block:
    return Block.of(s, {"part": with_fid(_t(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")})


def cell_update(s: SparkSession, d: str) -> DataFrame:
    """Two cells of row 5 written, one after another."""
    return _part_block(s, d).update_cell("part", 5, "p_size", 99).update_cell("part", 5, "p_retailprice", 1.5)["part"].df


def save_load(s: SparkSession, d: str) -> DataFrame:
    """A block saved, loaded, published to the application's sessions and attached again."""
    where = shared_path(s, "block")
    Block.of(s, {"nation": with_fid(_t(s, d, "nation"), "n_nationkey"), "part": _part_block(s, d)["part"].df}).save(where)
    back = Block.load(s, where)
    name = where.rsplit("-", 1)[1]
    back.share(f"b{name}")
    got = Block.attach(s, f"b{name}")
    out = got[1].df.withColumn("layers", F.lit(len(got)))
    back.unlink(f"b{name}")
    got.close()
    return out


def ref_value_copy(s: SparkSession, d: str) -> DataFrame:
    """Assigning a reference copies the source row's fields into the row that is referenced now: order 3's customer takes those of customer 1."""
    customers = with_fid(_t(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey")
    orders = with_fid(_t(s, d, "orders").select("o_orderkey", F.struct(F.lit(1).alias("ilayer"), F.col("o_custkey").cast("long").alias("ifeature")).alias("customer")), "o_orderkey")
    return Block.of(s, {"orders": orders, "customer": customers}).assign_ref("orders", 3, "customer", (1, 1))["customer"].df


def string_intern(s: SparkSession, d: str) -> DataFrame:
    """Dictionary ids in order of first appearance."""
    first = _t(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("at"))
    return with_fid(first, "at").select(F.col(FID).alias("id"), "p_brand")


def defaults(s: SparkSession, d: str) -> DataFrame:
    """Missing cells read as their types' defaults."""
    e = _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"))
    return with_defaults(e, T.StructType([e.schema["event_id"], field("v", "f64"), field("t", "str")]))


def wide_length(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select("doc_id", codec.utf16_units(F.coalesce("text", F.lit(""))).cast("long").alias("units"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Orders with their customers dereferenced, within a box of price and balance."""
    o = dereference(_orders(s, d), "customer", _customers(s, d), "c_")
    return o.where(F.col("o_totalprice").between(1000.0, 200000.0) & F.col("c_c_acctbal").between(0.0, 5000.0)).select("o_orderkey", "o_totalprice", F.col("c_c_mktsegment").alias("segment"), F.col("c_c_acctbal").alias("acctbal"))


QUERIES = {f.__name__: f for f in (layer_scan, layer_scan_wide, layer_scan_ties, point_lookup, name_lookup, ref_deref, ref_chain, ref_dangling, push_children, truncate_block, layer_stats, column_update, cell_update, save_load, ref_value_copy, string_intern, defaults, wide_length, flagship)}
ORACLE_SQL = {
    "layer_scan": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _fid, * FROM orders",
    "layer_scan_wide": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _fid, * FROM documents",
    "layer_scan_ties": "SELECT row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber) - 1 AS _fid, l_orderkey, l_linenumber FROM lineitem",
    "point_lookup": "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _fid, o_orderkey, o_custkey, o_orderstatus FROM orders) WHERE _fid IN (17, 4711)",
    "name_lookup": "SELECT * FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _fid, CAST(n_nationkey AS DOUBLE) AS x, CAST(n_regionkey AS DOUBLE) AS y, lower(n_name) AS name FROM nation) WHERE name IN ('france', 'china')",
    "ref_deref": "SELECT o_orderkey, c_mktsegment AS segment, c_acctbal AS acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "ref_chain": "SELECT n_name AS nation, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "ref_dangling": "SELECT event_id, c_mktsegment AS segment, c_custkey IS NULL AS dangling FROM events LEFT JOIN customer ON user_id = c_custkey",
    "push_children": "SELECT f AS _fid, number, 2 * f AS total, 2 * f + 1 AS paid, o_totalprice AS t_amount, o_orderstatus AS t_status, 0::DOUBLE AS p_amount, '' AS p_status FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS f, CAST(o_orderkey AS BIGINT) AS number, * FROM orders)",
    "truncate_block": "WITH n AS (SELECT row_number() OVER () - 1 AS f FROM nation) SELECT f AS _fid, 'Money' AS layer, 0::DOUBLE AS x, '' AS name, -1::BIGINT AS ref FROM (SELECT f FROM n UNION ALL SELECT f + (SELECT count(*) FROM nation) FROM n) UNION ALL SELECT i, 'spots', 0::DOUBLE, '', -1 FROM range(3) t(i) UNION ALL SELECT f, 'purchases', 0::DOUBLE, '', f + (SELECT count(*) FROM nation) FROM n",
    "layer_stats": " UNION ALL ".join(f"SELECT '{t}' AS layer, {i} AS i, count(*) AS n, CAST(min({x}) AS DOUBLE) AS minx, CAST(min({y}) AS DOUBLE) AS miny, CAST(max({x}) AS DOUBLE) AS maxx, CAST(max({y}) AS DOUBLE) AS maxy FROM {t}" for i, (t, (x, y)) in enumerate(_PLACES.items())),
    "column_update": "SELECT l_linenumber, round(sum(l_quantity + 1), 2) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1",
    "cell_update": "SELECT f AS _fid, p_partkey, CASE WHEN f = 5 THEN 99 ELSE p_size END AS p_size, CASE WHEN f = 5 THEN 1.5 ELSE p_retailprice END AS p_retailprice FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS f, * FROM part)",
    "save_load": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _fid, p_partkey, p_size, p_retailprice, 2 AS layers FROM part",
    "ref_value_copy": "WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS f, * FROM customer), o AS (SELECT o_custkey AS t FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3), v AS (SELECT c_custkey AS k, c_acctbal AS a, c_mktsegment AS m FROM c WHERE f = 1) SELECT f AS _fid, CASE WHEN f = t THEN k ELSE c_custkey END AS c_custkey, CASE WHEN f = t THEN a ELSE c_acctbal END AS c_acctbal, CASE WHEN f = t THEN m ELSE c_mktsegment END AS c_mktsegment FROM c, o, v",
    "string_intern": "SELECT row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id, p_brand FROM part GROUP BY p_brand",
    "defaults": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN coalesce(value, 0) ELSE 0 END AS v, CASE WHEN event_id % 5 <> 0 THEN coalesce(event_type, '') ELSE '' END AS t FROM events",
    "wide_length": "SELECT doc_id, CAST(length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents",
    "flagship": "SELECT o_orderkey, o_totalprice, c_mktsegment AS segment, c_acctbal AS acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 1000 AND 200000 AND c_acctbal BETWEEN 0 AND 5000",
}
