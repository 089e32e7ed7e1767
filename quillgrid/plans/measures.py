"""Operators on points, boxes, geometries and polygons whose results have a closed form, each against that form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blobgeom, codec, geometry, mbr, path, textgeom
from ..functions import collection as C
from ..operators import grids, tiles
from ..sources import container, importer, parts, shapefile
from ..staging import shared_path, spread
from ..store import Block, with_fid
from ..types import BY_NAME, FID, field

#: Whole numbers that vary with the supplier, from which boxes and lines are made.
_BASE = ("s_suppkey AS k", "double(s_suppkey % 7) AS x", "double(s_suppkey % 5) AS y", "double(s_suppkey % 3 + 2) AS w", "double(s_suppkey % 4) AS u", "double(s_suppkey % 6) AS v")
_SQL = "(SELECT s_suppkey AS k, CAST(s_suppkey % 7 AS DOUBLE) AS x, CAST(s_suppkey % 5 AS DOUBLE) AS y, CAST(s_suppkey % 3 + 2 AS DOUBLE) AS w, CAST(s_suppkey % 4 AS DOUBLE) AS u, CAST(s_suppkey % 6 AS DOUBLE) AS v FROM supplier)"


def _base(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").selectExpr(*_BASE)


def _spread(s: SparkSession, d: str) -> DataFrame:
    """The same, for what takes milliseconds a row."""
    return spread(_base(s, d), 1000)


def _ring(*xy: tuple[Column | float, Column | float]) -> Column:
    return F.array(*[path.point(*(v if isinstance(v, Column) else F.lit(float(v)) for v in p)) for p in xy])


def _box(x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float) -> Column:
    """A counter-clockwise ring, not closed."""
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _hole(x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float) -> Column:
    return _ring((x0, y0), (x0, y1), (x1, y1), (x1, y0))


def _closed(ring: Column) -> Column:
    return F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: C.vertex(p["x"], p["y"]))


def _area(paths: Column) -> Column:
    return F.aggregate(paths, F.lit(0.0), lambda acc, p: acc + path.signed_area(p))


def _length(paths: Column) -> Column:
    return F.aggregate(paths, F.lit(0.0), lambda acc, p: acc + path.length(p))


def point_arithmetic(s: SparkSession, d: str) -> DataFrame:
    """Middles, products, mirror images and nearness of three points."""
    a, b, c = path.point(F.col("x"), F.col("y")), path.point(F.col("u"), F.col("v") + 0.5), path.point(F.col("w"), F.col("k") % 11)
    mid, back = path.mid_point(a, b), path.reflect(a, b)
    return _base(s, d).select(
        "k", mid["x"].alias("mx"), mid["y"].alias("my"), back["x"].alias("rx"), back["y"].alias("ry"), path.cross_product(a, b, c).alias("cross"), F.signum(path.cross_product(a, b, c)).alias("side"),
        path.dot_product(a, b, c).alias("dot"), path.distance_squared(a, b).alias("d2"), path.near_equal(a, b, 9.0).alias("near"), path.near_collinear(a, b, c, 0.1).alias("aligned"), path.is_collinear(_grid(a), _grid(b), _grid(c)).alias("collinear"),
        path.translate(F.array(a), 1.5, -2.0)[0]["x"].alias("tx"), path.scale(F.array(a), 3.0, 0.5)[0]["y"].alias("sy"),
    )


def _grid(p: Column) -> Column:
    """A point in halves, so that its coordinates are whole."""
    return path.point(p["x"] * 2, p["y"] * 2)


def box_arithmetic(s: SparkSession, d: str) -> DataFrame:
    """Boxes of corners whichever way round; their sizes, scaled ones, and what they contain."""
    a, b = mbr.box(F.col("x"), F.col("y"), F.col("u"), F.col("v")), mbr.box(F.lit(1.0), F.lit(4.0), F.col("w"), F.lit(1.0))
    big = mbr.scale(a, 2.5)
    return _base(s, d).select(
        "k", mbr.width(a).alias("width"), mbr.height(a).alias("height"), mbr.area(a).alias("area"), big["maxx"].alias("big_x"), big["miny"].alias("big_y"), mbr.contains(a, b).alias("holds"),
        mbr.within(a, b).alias("is_held"), mbr.equal(a, mbr.box(F.col("u"), F.col("v"), F.col("x"), F.col("y"))).alias("same"), mbr.touches(a, b).alias("touches"), codec.in_extent(F.col("x"), F.col("v"), (1.0, 0.0, 5.0, 4.0)).alias("valid"),
    )


def contains_path_boxes(s: SparkSession, d: str) -> DataFrame:
    """Whether one box's corners lie mostly in another."""
    inner, outer = _box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")), _box(F.col("u"), F.col("v"), F.col("u") + 5, F.col("v") + 5)
    return _base(s, d).select("k", path.contains_path(inner, outer).alias("inside"))


def point_in_holed_polygon(s: SparkSession, d: str) -> DataFrame:
    """A point against a square with a square hole."""
    hole = _hole(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))
    place = path.point_in_polygon(F.col("u") * 3 + 1.25, F.col("v") + 1.25, _box(0, 0, 11, 11), F.array(hole))
    return _base(s, d).select("k", place.alias("inside"))


def strip_near(s: SparkSession, d: str) -> DataFrame:
    """A path of steps of 1 in x and less in y: points nearer than 2.5 to the last one kept go."""
    p = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: path.point(i, F.col("v") / 100))
    kept = path.strip_near_equal(p, 6.25)
    return _base(s, d).select("k", F.size(kept).alias("n"), F.element_at(kept, -1)["x"].alias("last"))


def snapped(s: SparkSession, d: str) -> DataFrame:
    """Points of a path on a grid of 5, and lines on a grid of 1, where two vertices may become one."""
    on = path.snap(F.array(path.point(F.col("x") * 3, F.col("y") * 7)), 5.0)[0]
    line = C.whole("LineString", F.array(C.part(2, F.array(C.vertex(0.2, 0.1), C.vertex(F.col("x"), F.col("y")), C.vertex(F.col("x") + 0.2, F.col("y") - 0.1), C.vertex(10.3, 10.4)))))
    g = C.snap_to_grid(line, 1.0)
    return _base(s, d).select("k", on["x"].alias("x"), on["y"].alias("y"), C.point_count(g).alias("n"), C.vertex_at(g, C.point_count(g) - 1)["x"].alias("last"))


def _two_polygons() -> Column:
    """A square, with a triangular hole where k is even, and a triangle."""
    square = C.part(3, _closed(_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))))
    hole = C.part(4, _closed(_ring((F.col("x") + 0.5, F.col("y") + 0.5), (F.col("x") + 0.5, F.col("y") + 1.5), (F.col("x") + 1.5, F.col("y") + 0.5))))
    far = C.part(3, _closed(_ring((20, 20), (F.col("u") + 21, 20), (20, 22))))
    return C.whole("MultiPolygon", F.when(F.col("k") % 2 == 0, F.array(square, hole, far)).otherwise(F.array(square, far)))


def geometry_counts(s: SparkSession, d: str) -> DataFrame:
    """Vertices, parts, polygons and where they begin."""
    g = F.col("g")
    b = C.bounds(g)
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return _base(s, d).withColumn("g", _two_polygons()).select(
        "k", C.point_count(g).alias("points"), C.part_count(g).alias("parts"), C.polygon_count(g).alias("polygons"), text(C.polygon_first_part(g)).alias("first_parts"), text(C.polygon_part_count(g)).alias("rings"),
        C.part_first_point(g, 1).alias("second_starts"), F.size(F.get(g["parts"], F.lit(1))["points"]).alias("second_holds"), C.vertex_at(g, 2)["x"].alias("x2"), C.vertex_at(g, 99).isNull().alias("outside"),
        C.dimension(g).alias("dimension"), C.type_code(g).alias("code"), C.is_empty(g).alias("is_empty"), C.is_closed(g).alias("is_closed"), C.has_open_ring(g).alias("open_ring"), C.is_toxic(g).alias("toxic"),
        C.area_of(g).alias("area"), b["minx"].alias("minx"), b["maxy"].alias("maxy"), C.clockwise(g["parts"][0]["points"]).alias("clockwise"),
    )


def geometry_building(s: SparkSession, d: str) -> DataFrame:
    """Geometries made of others, taken apart again, in other dimensions and the other way round."""
    p, q = C.make_point(F.col("x"), F.col("y"), F.lit(3.0)), C.make_point(F.col("x") + 1, F.col("v"), F.lit(5.0))
    line, square = C.make_line(p, q), C.box_polygon(F.col("u"), F.col("v"), F.col("u") + F.col("w"), F.col("v") + 1)
    every = C.merge(C.merge(square, C.cast_dim(line, "XY")), C.cast_dim(p, "XY"))
    whole = F.col("every")
    turned = C.reverse(C.cast_dim(line, "XYZM", m=7.0))
    moved = C.map_vertices(line, lambda v: C.vertex(v["x"] + 10, v["y"], v["z"]))
    return _base(s, d).withColumn("every", every).select(
        "k", whole["kind"].alias("kind"), C.part_count(whole).alias("parts"), C.extract_points(whole)["kind"].alias("points"), C.extract_lines(whole)["kind"].alias("lines"), C.extract_polygons(whole)["kind"].alias("polygons"),
        C.part_count(C.dissolve_points(whole)).alias("dissolved"), C.part_count(C.dissolve_segments(whole)).alias("sides"), C.length_of(C.linearize(whole)).alias("edge"), line["dim"].alias("dim"),
        C.vertex_at(turned, 0)["y"].alias("turned_y"), C.vertex_at(turned, 0)["m"].alias("turned_m"), C.vertex_at(moved, 0)["x"].alias("moved_x"), C.area_of(C.circle_box(F.col("x"), F.col("y"), 2.0)).alias("circle_box"),
        C.clockwise(C.wind(square)["parts"][0]["points"]).alias("wound"), C.z_range(line)["high"].alias("high"), C.m_range(turned)["low"].alias("measure"), C.make_polygon(line).isNull().alias("no_polygon"), C.overlaps_box(whole, mbr.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("meets"),
    )


def geometry_repair(s: SparkSession, d: str) -> DataFrame:
    """Open rings closed, repeated vertices and what is too short removed."""
    open_ring = C.part(3, F.transform(_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + 1), lambda p: C.vertex(p["x"], p["y"])))
    again = C.vertex(F.col("u"), F.col("v"))
    line, dot = C.part(2, F.array(again, again, C.vertex(9, 9))), C.part(1, F.array(again))
    g = C.whole("GeometryCollection", F.array(dot, dot, line, C.part(2, F.array(again, again)), open_ring))
    closed = C.close_rings(g)
    return _base(s, d).select(
        "k", C.has_open_ring(g).alias("open_before"), C.has_open_ring(closed).alias("open_after"), C.point_count(closed).alias("points"), C.point_count(C.remove_repeated_points(closed)).alias("unrepeated"),
        C.part_count(C.remove_repeated_points(closed)).alias("parts"), C.part_count(C.sanitize(closed)).alias("sane"), C.is_toxic(C.sanitize(closed)).alias("toxic"),
    )


def line_referencing(s: SparkSession, d: str) -> DataFrame:
    """Measures along a line of two sides, places between measures, and how much it bends."""
    line = C.whole("LineString", F.array(C.part(2, F.array(C.vertex(0, 0), C.vertex(F.col("w"), 0), C.vertex(F.col("w"), F.col("v") + 1)))))
    m = F.col("m")
    cut = C.locate_between(m, F.col("w") / 2, F.col("w"))
    plain = path.of_points(*[C.vertex_at(line, i) for i in range(3)])
    straight = path.of_points(path.point(F.lit(0.0), F.lit(0.0)), path.point(F.col("w"), F.lit(0.0)))
    return _base(s, d).withColumn("m", C.add_measure(line, 0.0, F.col("w") + F.col("v") + 1)).select(
        "k", m["dim"].alias("dim"), C.vertex_at(m, 1)["m"].alias("corner"), C.measure_at_point(m, path.point(F.col("w") + 1, F.lit(0.5))).alias("nearest"), C.is_trajectory(m).alias("trajectory"),
        C.trajectory_point(m, F.col("w") + 0.5)["parts"][0]["points"][0]["y"].alias("at_y"), F.round(C.length_of(cut), 6).alias("cut"), F.round(C.curvosity(plain), 6).alias("bend"),
        F.round(C.curvosity(straight, 3), 6).alias("straight"), F.round(C.curvosity(plain, 1), 6).alias("bend_1"), path.running(F.transform(path.segments(plain), lambda e: path.distance(e["a"], e["b"])))[2].alias("run"),
    )


def polygon_fills(s: SparkSession, d: str) -> DataFrame:
    """Two boxes as one subject under every fill rule, alone and against a clip."""
    a, b = _box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w")), _box(F.col("u"), F.col("v"), F.col("u") + 3, F.col("v") + 3)
    none, all_ = F.array().cast(geometry.PATHS), F.array(_box(-1, -1, 12, 12))
    merged = lambda fill, op="union", clip=none: F.round(_area(geometry.boolean(op, F.array(a, b), clip, fill)), 4)
    side = geometry.boolean("union", F.array(_box(0, 0, F.col("w"), 2), _box(F.col("w"), 0, 9, 2)), none)
    return _spread(s, d).select(
        "k", merged("nonzero").alias("nonzero"), merged("evenodd").alias("evenodd"), merged("positive").alias("positive"), merged("negative").alias("negative"),
        merged("nonzero", "difference", all_).alias("nothing"), merged("evenodd", "xor", all_).alias("inverse"), F.size(side[0]).alias("corners"),
    )


def polygon_tree(s: SparkSession, d: str) -> DataFrame:
    """A square, a hole in it, an island in the hole, and a square beside: what a difference and a union leave."""
    ring = geometry.boolean("difference", F.array(_box(0, 0, 30, 30)), F.array(_box(F.col("x") + 1, 2, F.col("x") + 15, 20)))
    every = geometry.boolean("union", F.concat(ring, F.array(_box(F.col("x") + 3, 5, F.col("x") + 6, 9), _box(40, 0, 41, 1))), F.array().cast(geometry.PATHS))
    t = geometry.tree(every)
    return _spread(s, d).select("k", F.size(t).alias("rings"), F.size(F.filter(t, lambda r: r["hole"])).alias("holes"), F.size(F.filter(t, lambda r: r["parent"] < 0)).alias("roots"), F.size(F.filter(t, lambda r: ~r["hole"] & (r["parent"] >= 0))).alias("islands"), F.round(_area(every), 4).alias("area"))


def offset_joins(s: SparkSession, d: str) -> DataFrame:
    """A square grown with every join, a line with every end, a square shrunk, a ring's outline, and distances that vary."""
    square = F.array(_box(0, 0, F.col("w"), F.col("w")))
    line = F.array(_ring((F.col("x"), 1), (F.col("x") + F.col("w"), 1)))
    grown = lambda join, delta=1.0, end="polygon", paths=square: _area(geometry.inflate(paths, delta, join, end))
    wedge = geometry.inflate_by(_ring((0, 0), (10, 0)), F.array(F.lit(1.0), F.lit(1.0)), "miter", "butt")
    return _spread(s, d).select(
        "k", F.round(grown("bevel"), 2).alias("bevel"), F.round(grown("square"), 1).alias("square"), F.round(grown("miter"), 4).alias("miter"), F.round(grown("round"), 0).alias("round"), F.round(grown("miter", -0.5), 4).alias("shrunk"),
        F.round(grown("miter", 0.25, "joined"), 2).alias("outline"), F.round(grown("miter", 0.5, "butt", line), 2).alias("butt"), F.round(grown("miter", 0.5, "square", line), 2).alias("ends"), F.round(grown("round", 0.5, "round", line), 1).alias("rounded"),
        F.round(_area(wedge), 2).alias("varying"), F.size(geometry.inflate(square, -3.0, "miter")).alias("gone"),
    )


def polygon_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines cut by a box and by polygons, sums and differences of patterns, and paths made simpler."""
    line = F.array(_ring((F.col("x") - 5, F.col("y")), (F.col("x") + 5, F.col("y"))))
    box = F.struct(F.lit(0.0).alias("minx"), F.lit(0.5).alias("miny"), F.lit(4.0).alias("maxx"), F.lit(3.5).alias("maxy"))
    square = _box(F.col("u"), 0.5, F.col("u") + 2, 3.5)
    pattern = _box(0, 0, 1, 2)
    bumpy = _ring((0, 0), (F.col("w"), F.lit(0.1)), (F.col("w") + 3, 0), (F.col("w") + 3, 6), (0, 6))
    straight = _ring((0, 0), (F.col("x") + 1, 0), (F.col("x") + 2, 0), (20, 0), (20, 20), (0, 20))
    long = _ring((0, 0), (2, F.col("v") / 100), (4, 0), (6, F.col("v")), (8, 0), (10, 0))
    return _spread(s, d).select(
        "k", F.round(_length(geometry.rect_clip(box, line, lines=True)), 4).alias("in_box"), F.round(_length(geometry.clip_lines("intersection", line, F.array(square))), 4).alias("within"),
        F.round(_length(geometry.clip_lines("difference", line, F.array(square))), 4).alias("without"), F.round(_area(geometry.minkowski(pattern, _box(0, 0, F.col("w") + 2, F.col("w") + 4), sign=-1)), 4).alias("difference"),
        F.size(geometry.simplify(F.array(bumpy), 0.5)[0]).alias("simplified"), F.size(geometry.trim_collinear(F.array(straight))[0]).alias("trimmed"), F.size(geometry.trim_collinear(F.array(F.slice(straight, 1, 4)), True)[0]).alias("trimmed_open"),
        F.size(geometry.douglas_peucker(F.array(long), 0.5)[0]).alias("peucker"),
    )


def text_formats(s: SparkSession, d: str) -> DataFrame:
    """A line and a point in every text format, and read back from it."""
    line = C.whole("LineString", F.array(C.part(2, F.array(C.vertex(F.col("x"), F.col("y")), C.vertex(F.col("x") + 1, F.col("v") + 0.5)))), srid=4326)
    dot = C.make_point(F.col("u"), F.col("v") + 0.25)
    t, b, last = textgeom, blobgeom, lambda g: C.vertex_at(g, 1)["y"]
    return _spread(s, d).withColumn("line", line).withColumn("dot", dot).select(
        "k", t.st_as_wkt("line").alias("wkt"), t.st_as_ewkt("line").alias("ewkt"), t.st_as_geojson("dot").alias("geojson"), t.st_as_kml("line").alias("kml"), t.st_as_gml("line").alias("gml"), t.st_as_svg("line").alias("svg"), F.substring(b.st_as_hex_wkb("dot"), 1, 10).alias("hex"),
        last(t.st_from_wkt(t.st_as_ewkt("line"))).alias("from_ewkt"), last(t.st_from_geojson(t.st_as_geojson("line"))).alias("from_geojson"), last(b.st_from_kml(t.st_as_kml("line"))).alias("from_kml"), last(b.st_from_gml(t.st_as_gml("line"))).alias("from_gml"),
        b.st_from_gml(t.st_as_gml("line"))["srid"].alias("gml_srid"), t.st_from_wkb(t.st_as_ewkb("line"))["srid"].alias("ewkb_srid"), last(b.st_from_hex_wkb(b.st_as_hex_wkb("line"))).alias("from_hex"),
    )


def plain_codes(s: SparkSession, d: str) -> DataFrame:
    """Doubles and floats as they are stored, boxes grown by a quantum, and codes beyond their range."""
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("q"))
    box = codec.padded_box(F.col("q"), F.col("q"), F.col("q") + 0.5, F.lit(2.0), (0.0, 0.0, 1.0, 1.0))
    return li.select("l_orderkey", F.col("p").cast(BY_NAME["f64"].spark).alias("f64"), F.col("p").cast(BY_NAME["f32"].spark).cast("double").alias("f32"), codec.encode(F.col("q") + 1, "tx16", 0.0, 1.0).alias("clamped"), box["maxy"].alias("maxy"), codec.signed32(F.col("l_orderkey") * 1_000_003).alias("wrapped"))


def layer_walk(s: SparkSession, d: str) -> DataFrame:
    """The rows of a layer, one after another in order, as a cursor meets them; a column of it; its summary."""
    layer = Block.of(s, {"nation": with_fid(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("n_nationkey", metadata=field("n_nationkey", "i32").metadata), F.col("n_name").alias("n_name", metadata=field("n_name", "str").metadata)), "n_nationkey")})["nation"]
    met = s.createDataFrame([(i, r["n_nationkey"]) for i, r in enumerate(layer)], "_fid long, met int")
    text = importer.dump(Block.of(s, {"nation": layer.df}))
    return layer.column("n_name").join(met, FID).select(FID, "met", "n_name", F.lit(text).alias("dump"), F.lit(layer.summary()).alias("summary"), F.lit(",".join(f.name for f in layer.fields)).alias("fields"))


def _put(s: SparkSession, where: str, raw: bytes) -> None:
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    out = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def batch_import(s: SparkSession, d: str) -> DataFrame:
    """Customers as a text file with geometries, imported by a configuration, in a container, and read from that."""
    root = shared_path(s, "import")
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("POINT("), F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(")")).alias("wkt"))
    c.write.csv(f"{root}/customers", header=True, quoteAll=True)
    where, block, failed = importer.run(s, f"{root}/out.db # the container\n[csv]{root}/customers!all -l customers cf64 st32 aabbox(no)\n{root}/none.shp -l none\n")
    container.save(block, where)
    back = container.load(s, where)["customers"].df
    return back.select(FID, "key", "segment", C.vertex_at(F.col("_geom"), 0)["x"].alias("x"), C.vertex_at(F.col("_geom"), 0)["y"].alias("y"), F.lit(len(failed)).alias("failed"))


def shapefile_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as a shapefile of polygons with a table, written to the shared folder and read."""
    root = shared_path(s, "shape")
    g = _base(s, d).select(_two_polygons().alias("geom"), "k", F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), F.col("w"))
    for ext, raw in shapefile.shapefile_bytes(g.orderBy("k")).items():
        _put(s, f"{root}/boxes.{ext}", raw)
    back = shapefile.read_shapefile(s, f"{root}/boxes.shp")
    return back.select("row", "k", "name", "w", F.round(C.area_of(F.col("geom")), 4).alias("area"), C.part_count(F.col("geom")).alias("parts"))


def container_geometries(s: SparkSession, d: str) -> DataFrame:
    """Lines with boxes in quantised coordinates and polygons in doubles, through a container."""
    extent = (0.0, 0.0, 65535.0, 65535.0)  # a unit a code
    line = C.whole("LineString", F.array(C.part(2, F.array(C.vertex(F.col("x"), F.col("y")), C.vertex(F.col("x") + F.col("w"), F.col("v") + 10)))))
    out = {}
    for name, g, shape, coord in (("lines", line, "line", "tx16"), ("areas", _two_polygons(), "polygon", "cf64")):
        f = parts.geom_field("g", shape, coord, extent, True)
        out[name] = with_fid(_base(s, d), "k").select(FID, F.col("k").cast("long").alias("k", metadata=field("k", "u32").metadata), g.alias("g", metadata=f.metadata))
    where = shared_path(s, "container")
    container.save(Block.of(s, out), where)
    back = container.load(s, where)
    row = lambda n: back[n].df.select(FID, F.lit(n).alias("layer"), "k", C.point_count(F.col("_geom")).alias("points"), C.vertex_at(F.col("_geom"), 1)["x"].alias("x1"), (F.col("_box.maxx") >= C.bounds(F.col("_geom"))["maxx"]).alias("boxed"))
    return row("lines").unionByName(row("areas"))


def triangle_bins(s: SparkSession, d: str) -> DataFrame:
    """Customers by how many triangles of side 400 they lie in."""
    p = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", C.make_point(F.col("c_acctbal"), F.col("c_custkey") + 0.123).alias("g"))
    hit = grids.cells(p, "g", 400.0, "triangle").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return hit.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


def tile_touch(s: SparkSession, d: str) -> DataFrame:
    """Tiles with the frame in which they were last drawn; those drawn are loaded."""
    t = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS id", "bigint(s_suppkey % 9) AS last_frame", "s_suppkey % 2 = 0 AS loaded")
    return tiles.touch(t, t.where("id % 3 = 0").select("id").unionByName(t.where("id % 6 = 0").select("id")), 100).select("id", "last_frame", "loaded")


QUERIES = {
    f.__name__: f
    for f in (
        point_arithmetic, box_arithmetic, contains_path_boxes, point_in_holed_polygon, strip_near, snapped, geometry_counts, geometry_building, geometry_repair, line_referencing, polygon_fills, polygon_tree,
        offset_joins, polygon_lines, text_formats, plain_codes, layer_walk, batch_import, shapefile_roundtrip, container_geometries, triangle_bins, tile_touch,
    )
}

_overlap = "greatest(least(x + w, u + 3) - greatest(x, u), 0) * greatest(least(y + w, v + 3) - greatest(y, v), 0)"
_corner_votes = " + ".join(f"CASE WHEN {a} > u AND {a} < u + 5 AND {b} > v AND {b} < v + 5 THEN 1 WHEN {a} < u OR {a} > u + 5 OR {b} < v OR {b} > v + 5 THEN -1 ELSE 0 END" for a, b in (("x", "y"), ("x + w", "y"), ("x + w", "y + w"), ("x", "y + w")))
_n = lambda e: f"CAST({e} AS INTEGER)"  # noqa: E731  whole numbers of doubles, to be written without a fraction
_num = lambda e: f"(CASE WHEN {e} = floor({e}) THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END)"
ORACLE_SQL = {
    "point_arithmetic": f"""SELECT k, (ax + bx) / 2 AS mx, (ay + b_y) / 2 AS my, 2 * bx - ax AS rx, 2 * b_y - ay AS ry, c AS "cross", CAST(sign(c) AS DOUBLE) AS side, (bx - ax) * (cx - bx) + (b_y - ay) * (cy - b_y) AS dot, d2, d2 < 9 AS near,
 c * c / (d2 * ((cx - bx) ** 2 + (cy - b_y) ** 2)) < 0.1 AS aligned, c = 0 AS collinear, ax + 1.5 AS tx, ay * 0.5 AS sy
 FROM (SELECT *, (bx - ax) * (cy - b_y) - (b_y - ay) * (cx - bx) AS c, (bx - ax) ** 2 + (b_y - ay) ** 2 AS d2 FROM (SELECT k, x AS ax, y AS ay, u AS bx, v + 0.5::DOUBLE AS b_y, w AS cx, CAST(k % 11 AS DOUBLE) AS cy FROM {_SQL}))""",
    "box_arithmetic": f"""SELECT k, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, x1 * 2.5::DOUBLE AS big_x, y0 * 2.5::DOUBLE AS big_y, 1 >= x0 AND w <= x1 AND 1 >= y0 AND 4 <= y1 AS holds, x0 >= 1 AND x1 <= w AND y0 >= 1 AND y1 <= 4 AS is_held, true AS same,
 (x0 <= w AND 1 <= x1 AND y0 <= 4 AND 1 <= y1) AND NOT (x0 < w AND 1 < x1 AND y0 < 4 AND 1 < y1) AS touches, x BETWEEN 1 AND 5 AND v BETWEEN 0 AND 4 AS valid FROM (SELECT *, least(x, u) AS x0, greatest(x, u) AS x1, least(y, v) AS y0, greatest(y, v) AS y1 FROM {_SQL})""",
    "contains_path_boxes": f"SELECT k, CASE WHEN n <> 0 THEN n > 0 ELSE x + w / 2 BETWEEN u AND u + 5 AND y + w / 2 BETWEEN v AND v + 5 END AS inside FROM (SELECT *, {_corner_votes} AS n FROM {_SQL})",
    "point_in_holed_polygon": f"SELECT k, px > 0 AND px < 11 AND py > 0 AND py < 11 AND NOT (px > x AND px < x + w AND py > y AND py < y + w) AS inside FROM (SELECT *, u * 3 + 1.25 AS px, v + 1.25 AS py FROM {_SQL})",
    "strip_near": f"SELECT k, 4 AS n, 9::DOUBLE AS last FROM {_SQL}",
    "snapped": f"SELECT k, round(x * 3 / 5) * 5 AS x, round(y * 7 / 5) * 5 AS y, CASE WHEN x = 0 AND y = 0 THEN 2 ELSE 3 END AS n, 10::DOUBLE AS last FROM {_SQL}",
    "geometry_counts": f"""SELECT k, CASE WHEN e THEN 13 ELSE 9 END AS points, CASE WHEN e THEN 3 ELSE 2 END AS parts, 2 AS polygons, CASE WHEN e THEN '0,2' ELSE '0,1' END AS first_parts, CASE WHEN e THEN '2,1' ELSE '1,1' END AS rings, 5 AS second_starts, 4 AS second_holds,
 x + w AS x2, true AS outside, 2 AS dimension, 6 AS code, false AS is_empty, false AS is_closed, false AS open_ring, false AS toxic, w * w - CASE WHEN e THEN 0.5 ELSE 0 END + u + 1 AS area, x AS minx, 22::DOUBLE AS maxy, false AS clockwise FROM (SELECT *, k % 2 = 0 AS e FROM {_SQL})""",
    "geometry_building": f"""SELECT k, 'GeometryCollection' AS kind, 3 AS parts, 'Point' AS points, 'LineString' AS lines, 'Polygon' AS polygons, 8 AS dissolved, 6 AS sides, 2 * w + 2 AS edge, 'XYZ' AS dim, v AS turned_y, 7::DOUBLE AS turned_m, x + 10 AS moved_x, 16::DOUBLE AS circle_box, true AS wound,
 5::DOUBLE AS high, 7::DOUBLE AS measure, true AS no_polygon, least(u, x) <= 1 AND least(v, y) <= 1 AS meets FROM {_SQL}""",
    "geometry_repair": f"SELECT k, true AS open_before, false AS open_after, 12 AS points, 9 AS unrepeated, 4 AS parts, 4 AS sane, false AS toxic FROM {_SQL}",
    "line_referencing": f"""SELECT k, 'XYM' AS dim, w AS corner, w + 0.5::DOUBLE AS nearest, true AS trajectory, 0.5::DOUBLE AS at_y, w / 2 AS cut, round(sqrt(w * w + h * h) / (w + h), 6) AS bend, 1::DOUBLE AS straight,
 round((sqrt(mx * mx + my * my) + sqrt((w - mx) ** 2 + (h - my) ** 2)) / (w + h), 6) AS bend_1, w + h AS run FROM (SELECT *, least((w + h) / 2, w) AS mx, greatest((w + h) / 2 - w, 0) AS my FROM (SELECT *, v + 1 AS h FROM {_SQL}))""",
    "polygon_fills": f"SELECT k, w * w + 9 - i AS nonzero, w * w + 9 - 2 * i AS evenodd, w * w + 9 - i AS positive, 0::DOUBLE AS negative, 0::DOUBLE AS nothing, 169 - (w * w + 9 - 2 * i) AS inverse, 4 AS corners FROM (SELECT *, {_overlap} AS i FROM {_SQL})",
    "polygon_tree": f"SELECT k, 4 AS rings, 1 AS holes, 2 AS roots, 1 AS islands, CAST(900 - 14 * 18 + 12 + 1 AS DOUBLE) AS area FROM {_SQL}",
    "offset_joins": f"""SELECT k, w * w + 4 * w + 2 AS bevel, round((w + 2) ** 2 - 4 * (sqrt(2) - 1) ** 2, 1) AS square, (w + 2) ** 2 AS miter, round(w * w + 4 * w + pi(), 0) AS round, (w - 1) ** 2 AS shrunk, (w + 0.5::DOUBLE) ** 2 - (w - 0.5::DOUBLE) ** 2 AS outline, w AS butt, w + 1 AS ends,
 round(w + pi() / 4, 1) AS rounded, 20::DOUBLE AS varying, 0 AS gone FROM {_SQL}""",
    "polygon_lines": f"""SELECT k, CASE WHEN y BETWEEN 0.5 AND 3.5 THEN greatest(least(x + 5, 4) - greatest(x - 5, 0), 0) ELSE 0 END AS in_box, i AS within, 10 - i AS without, ((w + 3) * (w + 6) - (w + 1) * (w + 2)) AS difference, 4 AS simplified, 4 AS trimmed, 2 AS trimmed_open,
 CASE WHEN v >= 2 THEN 5 WHEN v = 1 THEN 4 ELSE 2 END AS peucker FROM (SELECT *, CASE WHEN y BETWEEN 0.5 AND 3.5 THEN greatest(least(x + 5, u + 2) - greatest(x - 5, u), 0) ELSE 0 END AS i FROM {_SQL})""",
    "text_formats": f"""SELECT k, 'LINESTRING(' || a || ' ' || b || ', ' || c || ' ' || e || ')' AS wkt, 'SRID=4326;LINESTRING(' || a || ' ' || b || ', ' || c || ' ' || e || ')' AS ewkt, '{{"type":"Point","coordinates":[' || CAST(u AS VARCHAR) || ',' || CAST(v + 0.25 AS VARCHAR) || ']}}' AS geojson,
 '<LineString><coordinates>' || a || ',' || b || ' ' || c || ',' || e || '</coordinates></LineString>' AS kml, '<gml:LineString srsName="EPSG:4326"><gml:posList>' || a || ' ' || b || ' ' || c || ' ' || e || '</gml:posList></gml:LineString>' AS gml,
 'M ' || a || ' ' || CASE WHEN y = 0 THEN '0' ELSE '-' || b END || ' L ' || c || ' -' || e AS svg, '0101000000' AS hex, v + 0.5 AS from_ewkt, v + 0.5 AS from_geojson, v + 0.5 AS from_kml, v + 0.5 AS from_gml, 4326 AS gml_srid, 4326 AS ewkb_srid, v + 0.5 AS from_hex
 FROM (SELECT *, {_num('x')} AS a, {_num('y')} AS b, {_num('(x + 1)')} AS c, {_num('(v + 0.5::DOUBLE)')} AS e FROM {_SQL})""",
    "plain_codes": "SELECT l_orderkey, l_extendedprice AS f64, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS f32, CAST(65535 AS BIGINT) AS clamped, CAST(65535 AS BIGINT) AS maxy, CAST((CAST(l_orderkey AS BIGINT) * 1000003 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS wrapped FROM lineitem",
    "layer_walk": "WITH n AS (SELECT count(*) AS c FROM nation) SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _fid, CAST(n_nationkey AS INTEGER) AS met, n_name, s || chr(10) || '  scanned ' || c || ' rows' AS dump, s AS summary, 'n_nationkey,n_name' AS fields FROM nation, (SELECT c, '0 nation: ' || c || ' rows' || chr(10) || '  n_nationkey i32' || chr(10) || '  n_name str' AS s FROM n)",
    "batch_import": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _fid, CAST(c_custkey AS INTEGER) AS key, c_mktsegment AS segment, CAST(c_custkey AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, 1 AS failed FROM customer",
    "shapefile_roundtrip": f"SELECT row_number() OVER (ORDER BY k) - 1 AS \"row\", CAST(k AS BIGINT) AS k, 'n' || k AS name, w, w * w - CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0 END + u + 1 AS area, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS parts FROM {_SQL}",
    "container_geometries": f"SELECT row_number() OVER (ORDER BY k) - 1 AS _fid, 'lines' AS layer, CAST(k AS BIGINT) AS k, 2 AS points, x + w AS x1, true AS boxed FROM {_SQL} UNION ALL SELECT row_number() OVER (ORDER BY k) - 1, 'areas', k, CASE WHEN k % 2 = 0 THEN 13 ELSE 9 END, x + w, true FROM {_SQL}",
    "triangle_bins": "SELECT CAST(1 AS BIGINT) AS n, count(*) AS customers FROM customer",
    "tile_touch": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(100 AS BIGINT) ELSE CAST(s_suppkey % 9 AS BIGINT) END AS last_frame, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS loaded FROM supplier",
}
