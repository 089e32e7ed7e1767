"""Batch import of vector files into a block, by a configuration text, and the dump of a block's layers.

The first line of a configuration names the output; each further line a source:

    [driver]path[!layer] -l name coords st32 aabbox

coords is tx16, tx24, tx32, cf32 or cf64; st32 asks for wide string ids; the last token is aabbox(no), aabbox(auto) or
aabbox(minx,miny,maxx,maxy). Text after # is a comment. Sources that can't be read are skipped and reported.
"""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import textgeom
from ..staging import stored
from ..store import Block, with_fid
from ..types import FID, field
from . import parts
from .shapefile import read_shapefile

COORDS = ("tx16", "tx24", "tx32", "cf32", "cf64")


@dataclass(frozen=True)
class Source:
    path: str
    driver: str = ""
    layer: str = ""
    name: str = ""
    coords: str = "cf32"
    wide_strings: bool = False
    box: str | tuple[float, float, float, float] = "no"


def parse(text: str) -> tuple[str, list[Source]]:
    """The output path and the sources of a configuration; ValueError names a line that can't be read."""
    lines = [s for s in (x.split("#", 1)[0].strip() for x in text.splitlines()) if s]
    if not lines:
        raise ValueError("no output path")
    out = []
    for line in lines[1:]:
        m = re.match(r"(?:\[(?P<driver>[^\]]*)\])?(?P<path>[^!\s]+)(?:!(?P<layer>\S+))?\s*(?P<rest>.*)$", line)
        if not m:
            raise ValueError(line)
        name, coords, wide, box = "", "cf32", False, "no"
        tokens = shlex.split(m["rest"])
        i = 0
        while i < len(tokens):
            t = tokens[i].lower()
            if t == "-l" and i + 1 < len(tokens):
                i += 1
                name = tokens[i]
            elif t in COORDS:
                coords = t
            elif t == "st32":
                wide = True
            elif b := re.fullmatch(r"aabbox\((no|auto|[-+.\d e,]+)\)", t):
                box = b[1] if b[1] in ("no", "auto") else tuple(map(float, b[1].split(",")))
                if isinstance(box, tuple) and len(box) != 4:
                    raise ValueError(line)
            else:
                raise ValueError(line)
            i += 1
        out.append(Source(m["path"], m["driver"] or "", m["layer"] or "", name or m["layer"] or m["path"].rsplit("/", 1)[-1].split(".")[0], coords, wide, box))
    return lines[0], out


def shape_of(df: DataFrame, geom_col: str) -> tuple[str, tuple[float, float, float, float]]:
    """The shape of a column's geometries and their extent, in one aggregation; ValueError for mixed or no shapes."""
    g = F.col(geom_col)
    family = F.when(g["kind"] == "Point", "point").when(g["kind"].isin("LineString", "MultiLineString"), "line").when(g["kind"].isin("Polygon", "MultiPolygon"), "polygon").otherwise("other")
    points = F.flatten(F.transform(g["parts"], lambda p: p["points"]))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    found = df.where(g.isNotNull()).agg(
        F.collect_set(family).alias("families"), F.min(F.array_min(x)).alias("minx"), F.min(F.array_min(y)).alias("miny"),
        F.max(F.array_max(x)).alias("maxx"), F.max(F.array_max(y)).alias("maxy"),
    ).first()
    if len(found["families"]) != 1 or found["families"] == ["other"] or found["minx"] is None:
        raise ValueError(f"a layer holds points, lines or polygons, not {sorted(found['families'])}")
    return found["families"][0], (found["minx"], found["miny"], found["maxx"], found["maxy"])


def to_layer(df: DataFrame, geom_col: str, *order: str, coords: str = "cf32", box: str | tuple[float, float, float, float] = "no", wide_strings: bool = False) -> DataFrame:
    """A layer of df: strings, whole numbers (wrapped to 32 bits) and reals are kept, other columns go, rows without geometry too.

    Geometries become plane ones, to be stored in coords; a box given is also the extent, else the extent is that of
    the rows. An axis on which all rows are equal gets a width of 1, so that quantised coordinates are defined.
    """
    cols, schema = [], []
    for f in df.schema.fields:
        if f.name == geom_col:
            continue
        if isinstance(f.dataType, T.StringType):
            kind, c = "str", F.coalesce(F.col(f.name), F.lit(""))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            low = F.pmod(F.coalesce(F.col(f.name), F.lit(0)).cast("long"), F.lit(1 << 32))
            kind, c = "i32", F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            kind, c = "f64", F.coalesce(F.col(f.name).cast("double"), F.lit(0.0))
        else:
            continue
        meta = field(f.name, kind).metadata | ({"wide": True} if kind == "str" and wide_strings else {})
        cols.append(c.alias(f.name, metadata=meta))
        schema.append(f.name)
    shape, extent = shape_of(df, geom_col)
    if isinstance(box, tuple):
        extent = box
    x0, y0, x1, y1 = extent
    stored = parts.geom_field("geom", shape, coords, (x0, y0, x1 if x1 > x0 else x0 + 1, y1 if y1 > y0 else y0 + 1), box != "no")
    plane = F.transform(F.col(geom_col)["parts"], lambda p: p.withField("points", F.transform(p["points"], lambda q: q.withField("z", F.lit(None).cast("double")).withField("m", F.lit(None).cast("double")))))
    geom = F.col(geom_col).withField("dim", F.lit("XY")).withField("parts", plane).alias("geom", metadata=stored.metadata)
    kept = df.where(F.col(geom_col).isNotNull()).select(*cols, geom)
    return with_fid(kept, *(order or schema[:1] or ["geom"]))


def run(spark: SparkSession, text: str) -> tuple[str, Block, dict[str, str]]:
    """Output path, the block of all sources that could be read, and what went wrong with the others.

    Shapefiles are read by this package; any other driver name is a format of Spark with a WKT column named wkt.
    """
    where, sources = parse(text)
    layers: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for s in sources:
        try:
            if s.driver.lower() in ("", "esri shapefile") or s.path.endswith(".shp"):
                df, order = read_shapefile(spark, s.path).drop("file"), ("row",)
            else:
                raw = spark.read.format(s.driver.lower()).options(header=True, inferSchema=True).load(s.path)
                df, order = stored(raw.withColumn("geom", textgeom.st_from_wkt(F.col("wkt"))).drop("wkt"), "parsed"), ()  # texts are read once
            layers[s.name] = to_layer(df, "geom", *order, coords=s.coords, box=s.box, wide_strings=s.wide_strings)
        except Exception as x:  # noqa: BLE001  one bad source does not end the batch; the caller sees why
            failed[s.path] = str(x).splitlines()[0] if str(x) else type(x).__name__
    return where, Block.of(spark, layers), failed


def dump(block: Block) -> str:
    """The layers of a block: names, row counts, fields and their ranges, and how many rows a scan finds."""
    out = []
    for x in block.layers.values():
        n = x.df.agg(F.count(FID).alias("n")).first()["n"]
        out.append(f"{x.summary()}\n  scanned {n} rows")
    return "\n".join(out)
