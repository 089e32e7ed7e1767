"""Geometries as text and bytes: WKT, EWKT, WKB, EWKB, GeoJSON, KML, GML and SVG.

A geometry is a kind ("Point", "MultiPolygon", ...), a dimension ("XY", "XYZ", "XYM", "XYZM"), an SRID (0 for none) and
nested lists of coordinates, as in GeoJSON; a collection's content is a list of geometries. Writers of points and
lines over columns of their own are JVM-side expressions; parsers run in Arrow UDFs.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
#: Lists around a coordinate, by kind.
DEPTH = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiPoint": 1, "MultiLineString": 2, "MultiPolygon": 3}
DIMS = ("XY", "XYZ", "XYM", "XYZM")


@dataclass(frozen=True)
class Geometry:
    kind: str
    coords: list
    dim: str = "XY"
    srid: int = 0


def _number(v: float) -> str:
    return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


class _Reader:
    def __init__(self, text: str):
        self.tokens = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected text at {at}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self, want: str = "") -> str:
        t = self.peek()
        if want and t != want:
            raise ValueError(f"expected {want!r}, found {t!r}")
        self.at += 1
        return t

    def numbers(self) -> list[float]:
        out = []
        while self.peek() not in ("", ",", ")", "("):
            out.append(float(self.next()))
        return out

    def nested(self, depth: int, bare: bool = False) -> list:
        if depth == 0:
            return self.numbers()
        if self.peek().upper() == "EMPTY":
            self.next()
            return []
        self.next("(")
        out = [self._item(depth, bare)]
        while self.peek() == ",":
            self.next()
            out.append(self._item(depth, bare))
        self.next(")")
        return out

    def _item(self, depth: int, bare: bool) -> list:
        if depth == 1 and bare and self.peek() == "(":  # MULTIPOINT((1 2), (3 4))
            return self.nested(1)[0]
        return self.nested(depth - 1, bare)

    def geometry(self, srid: int) -> Geometry:
        word = self.next().upper()
        dim = ""
        for suffix in ("ZM", "Z", "M"):
            if word.endswith(suffix) and word[: -len(suffix)] in (k.upper() for k in KINDS):
                word, dim = word[: -len(suffix)], "XY" + suffix
        if self.peek().upper() in ("Z", "M", "ZM"):
            dim = "XY" + self.next().upper()
        kind = {k.upper(): k for k in KINDS}.get(word)
        if kind is None:
            raise ValueError(f"unknown geometry {word!r}")
        if kind == "GeometryCollection":
            if self.peek().upper() == "EMPTY":
                self.next()
                return Geometry(kind, [], dim or "XY", srid)
            self.next("(")
            parts = [self.geometry(srid)]
            while self.peek() == ",":
                self.next()
                parts.append(self.geometry(srid))
            self.next(")")
            return Geometry(kind, parts, dim or parts[0].dim, srid)
        coords = self.nested(1)[0] if kind == "Point" and self.peek().upper() != "EMPTY" else self.nested(max(1, DEPTH[kind]), kind == "MultiPoint")
        sample = coords
        while sample and isinstance(sample[0], list):
            sample = sample[0]
        width = len(sample) or len(dim or "XY")
        dim = dim or {2: "XY", 3: "XYZ", 4: "XYZM"}.get(width, "")
        if len(dim) != width:
            raise ValueError(f"{width} numbers for {dim or '?'}")
        return Geometry(kind, coords, dim, srid)


def from_wkt(text: str) -> Geometry:
    """Well-known text, or the extended form with SRID=n; before it. Raises ValueError for what is neither."""
    srid = 0
    if m := re.match(r"\s*SRID\s*=\s*(-?\d+)\s*;", text, re.IGNORECASE):
        srid, text = int(m[1]), text[m.end() :]
    r = _Reader(text)
    g = r.geometry(srid)
    if r.peek():
        raise ValueError(f"text after the geometry: {r.peek()!r}")
    return g


def _wkt_list(coords: list, depth: int) -> str:
    if depth == 0:
        return " ".join(map(_number, coords))
    return "(" + ", ".join(_wkt_list(c, depth - 1) for c in coords) + ")"


def to_wkt(g: Geometry, extended: bool = False) -> str:
    head = f"SRID={g.srid};" if extended and g.srid else ""
    tag = g.kind.upper() + (f" {g.dim[2:]}" if len(g.dim) > 2 else "")
    if not g.coords:
        return f"{head}{tag} EMPTY"
    if g.kind == "GeometryCollection":
        return f"{head}{tag}({', '.join(to_wkt(p) for p in g.coords)})"
    return f"{head}{tag}" + (f"({_wkt_list(g.coords, 0)})" if g.kind == "Point" else _wkt_list(g.coords, DEPTH[g.kind]))


def to_wkb(g: Geometry, little: bool = True, extended: bool = False) -> bytes:
    """Well-known bytes: thousands tell the dimension; extended: high bits do, and the SRID follows."""
    e = "<" if little else ">"
    code = KINDS.index(g.kind) + 1
    head = bytes([1 if little else 0])
    if extended:
        code |= (0x80000000 if "Z" in g.dim else 0) | (0x40000000 if "M" in g.dim else 0) | (0x20000000 if g.srid else 0)
        head += struct.pack(e + "I", code) + (struct.pack(e + "i", g.srid) if g.srid else b"")
    else:
        head += struct.pack(e + "I", code + 1000 * DIMS.index(g.dim))
    n = struct.Struct(e + "I").pack
    row = lambda c: struct.pack(f"{e}{len(g.dim)}d", *c)
    line = lambda cs: n(len(cs)) + b"".join(map(row, cs))
    if g.kind == "Point":
        return head + row(g.coords or [float("nan")] * len(g.dim))
    if g.kind == "LineString":
        return head + line(g.coords)
    if g.kind == "Polygon":
        return head + n(len(g.coords)) + b"".join(map(line, g.coords))
    parts = g.coords if g.kind == "GeometryCollection" else [Geometry(g.kind.removeprefix("Multi"), c, g.dim) for c in g.coords]
    return head + n(len(parts)) + b"".join(to_wkb(p, little, extended) for p in parts)


def from_wkb(raw: bytes) -> Geometry:
    """Well-known bytes of either byte order, plain or extended. Raises ValueError for what is neither."""

    def read(at: int, srid: int) -> tuple[Geometry, int]:
        e = {0: ">", 1: "<"}.get(raw[at])
        if e is None:
            raise ValueError("unknown byte order")
        (code,) = struct.unpack_from(e + "I", raw, at + 1)
        at += 5
        if code & 0xE0000000:
            dim = "XY" + ("Z" if code & 0x80000000 else "") + ("M" if code & 0x40000000 else "")
            if code & 0x20000000:
                (srid,) = struct.unpack_from(e + "i", raw, at)
                at += 4
            code &= 0x1FFFFFFF
        else:
            if code >= 4000:
                raise ValueError(f"unknown geometry {code}")
            dim, code = DIMS[code // 1000], code % 1000
        if not 1 <= code <= 7:
            raise ValueError(f"unknown geometry {code}")
        kind, width = KINDS[code - 1], len(dim)

        def count(at: int) -> tuple[int, int]:
            (n,) = struct.unpack_from(e + "I", raw, at)
            if n > len(raw):
                raise ValueError("a count beyond the input")
            return n, at + 4

        def line(at: int) -> tuple[list, int]:
            n, at = count(at)
            v = struct.unpack_from(f"{e}{n * width}d", raw, at)
            return [list(v[i : i + width]) for i in range(0, len(v), width)], at + 8 * len(v)

        if kind == "Point":
            c = list(struct.unpack_from(f"{e}{width}d", raw, at))
            return Geometry(kind, [] if c[0] != c[0] else c, dim, srid), at + 8 * width
        if kind == "LineString":
            c, at = line(at)
            return Geometry(kind, c, dim, srid), at
        n, at = count(at)
        parts: list = []
        for _ in range(n):
            p, at = line(at) if kind == "Polygon" else read(at, srid)
            parts.append(p if kind in ("Polygon", "GeometryCollection") else p.coords)
        return Geometry(kind, parts, dim, srid), at

    try:
        g, end = read(0, 0)
    except (struct.error, IndexError) as x:
        raise ValueError("bytes end early") from x
    if end != len(raw):
        raise ValueError("bytes after the geometry")
    return g


def to_geojson(g: Geometry) -> str:
    def plain(g: Geometry) -> dict:
        if g.kind == "GeometryCollection":
            return {"type": g.kind, "geometries": [plain(p) for p in g.coords]}
        return {"type": g.kind, "coordinates": g.coords}

    return json.dumps(plain(g), separators=(",", ":"))


def from_geojson(text: str) -> Geometry:
    def read(d: dict) -> Geometry:
        if d.get("type") == "Feature":
            return read(d["geometry"])
        if d.get("type") == "GeometryCollection":
            return Geometry(d["type"], [read(x) for x in d["geometries"]])
        if d.get("type") not in DEPTH:
            raise ValueError(f"unknown geometry {d.get('type')!r}")
        sample = d["coordinates"]
        while sample and isinstance(sample[0], list):
            sample = sample[0]
        return Geometry(d["type"], d["coordinates"], "XYZ" if len(sample) == 3 else "XY", 4326)

    try:
        return read(json.loads(text))
    except (KeyError, TypeError, AttributeError) as x:
        raise ValueError("not a GeoJSON geometry") from x


def to_kml(g: Geometry) -> str:
    text = lambda cs: " ".join(",".join(map(_number, c)) for c in cs)
    if g.kind == "Point":
        return f"<Point><coordinates>{text([g.coords])}</coordinates></Point>"
    if g.kind == "LineString":
        return f"<LineString><coordinates>{text(g.coords)}</coordinates></LineString>"
    if g.kind == "Polygon":
        ring = lambda r: f"<LinearRing><coordinates>{text(r)}</coordinates></LinearRing>"
        inner = "".join(f"<innerBoundaryIs>{ring(r)}</innerBoundaryIs>" for r in g.coords[1:])
        return f"<Polygon><outerBoundaryIs>{ring(g.coords[0])}</outerBoundaryIs>{inner}</Polygon>"
    parts = g.coords if g.kind == "GeometryCollection" else [Geometry(g.kind.removeprefix("Multi"), c, g.dim) for c in g.coords]
    return f"<MultiGeometry>{''.join(map(to_kml, parts))}</MultiGeometry>"


def to_gml(g: Geometry, srs: bool = True) -> str:
    name = f' srsName="EPSG:{g.srid}"' if srs and g.srid else ""
    text = lambda cs: " ".join(_number(v) for c in cs for v in c)
    if g.kind == "Point":
        return f"<gml:Point{name}><gml:pos>{text([g.coords])}</gml:pos></gml:Point>"
    if g.kind == "LineString":
        return f"<gml:LineString{name}><gml:posList>{text(g.coords)}</gml:posList></gml:LineString>"
    if g.kind == "Polygon":
        ring = lambda r: f"<gml:LinearRing><gml:posList>{text(r)}</gml:posList></gml:LinearRing>"
        inner = "".join(f"<gml:interior>{ring(r)}</gml:interior>" for r in g.coords[1:])
        return f"<gml:Polygon{name}><gml:exterior>{ring(g.coords[0])}</gml:exterior>{inner}</gml:Polygon>"
    parts = g.coords if g.kind == "GeometryCollection" else [Geometry(g.kind.removeprefix("Multi"), c, g.dim) for c in g.coords]
    return f"<gml:MultiGeometry{name}>{''.join(f'<gml:geometryMember>{to_gml(p, False)}</gml:geometryMember>' for p in parts)}</gml:MultiGeometry>"


def to_svg(g: Geometry, precision: int = 6) -> str:
    """SVG path data (a point's cx and cy), with y downward."""
    v = lambda x: _number(round(x, precision) + 0.0)
    path = lambda cs, end="": "M " + " L ".join(f"{v(c[0])} {v(-c[1])}" for c in cs) + end
    if g.kind == "Point":
        return f'cx="{v(g.coords[0])}" cy="{v(-g.coords[1])}"'
    if g.kind == "LineString":
        return path(g.coords)
    if g.kind == "Polygon":
        return " ".join(path(r, " Z") for r in g.coords)
    parts = g.coords if g.kind == "GeometryCollection" else [Geometry(g.kind.removeprefix("Multi"), c, g.dim) for c in g.coords]
    return (";" if g.kind == "MultiPoint" else " ").join(to_svg(p, precision) for p in parts)


# --- columns -------------------------------------------------------------------------------------------------------

#: The canonical geometry column: parts of 1 point, 2 line, 3 outer ring or 4 inner ring.
GEOM = "struct<srid:int,dim:string,kind:string,parts:array<struct<ptype:tinyint,points:array<struct<x:double,y:double,z:double,m:double>>>>>"


def as_struct(g: Geometry) -> dict:
    z, m = g.dim.find("Z"), g.dim.find("M")
    points = lambda cs: [{"x": c[0], "y": c[1], "z": c[z] if z > 0 else None, "m": c[m] if m > 0 else None} for c in cs]
    part = lambda t, cs: {"ptype": t, "points": points(cs)}

    def parts(g: Geometry) -> list:
        if not g.coords:
            return []
        if g.kind == "Point":
            return [part(1, [g.coords])]
        if g.kind == "LineString":
            return [part(2, g.coords)]
        if g.kind == "Polygon":
            return [part(3 if i == 0 else 4, r) for i, r in enumerate(g.coords)]
        below = g.coords if g.kind == "GeometryCollection" else [Geometry(g.kind.removeprefix("Multi"), c, g.dim) for c in g.coords]
        return [p for b in below for p in parts(b)]

    return {"srid": g.srid, "dim": g.dim, "kind": g.kind, "parts": parts(g)}


def of_struct(s: dict) -> Geometry:
    dim, kind = s["dim"], s["kind"]
    row = lambda p: [v for v, on in zip((p["x"], p["y"], p["z"], p["m"]), (1, 1, "Z" in dim, "M" in dim), strict=True) if on]
    parts = [(p["ptype"], [row(q) for q in p["points"]]) for p in s["parts"] or []]
    single: list[Geometry] = []
    for t, pts in parts:
        if t == 4:
            single[-1].coords.append(pts)
        else:
            single.append(Geometry({1: "Point", 2: "LineString", 3: "Polygon"}[t], pts[0] if t == 1 else [pts] if t == 3 else pts, dim, s["srid"]))
    if kind == "GeometryCollection":
        return Geometry(kind, single, dim, s["srid"])
    if kind.startswith("Multi"):
        return Geometry(kind, [g.coords for g in single], dim, s["srid"])
    return single[0] if single else Geometry(kind, [], dim, s["srid"])


_XYZM = pa.struct([(n, pa.float64()) for n in "xyzm"])
ARROW = pa.struct([("srid", pa.int32()), ("dim", pa.string()), ("kind", pa.string()), ("parts", pa.list_(pa.struct([("ptype", pa.int8()), ("points", pa.list_(_XYZM))])))])


def _values(a: pa.Array) -> list:
    return [None] * len(a) if a.null_count == len(a) else a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()


def structs(a: pa.Array) -> list[dict | None]:
    """The rows of a geometry column as dicts: a column of numbers at a time, since nested values one by one take long."""
    parts = a.field("parts")
    points = parts.values.field("points")
    v = points.values
    every = [{"x": x, "y": y, "z": z, "m": m} for x, y, z, m in zip(*[_values(v.field(n)) for n in "xyzm"], strict=True)]
    at = points.offsets.to_pylist()
    one = [{"ptype": t, "points": every[i:j]} for t, i, j in zip(_values(parts.values.field("ptype")), at, at[1:], strict=False)]
    at = parts.offsets.to_pylist()
    rows = zip(a.is_valid().to_pylist(), _values(a.field("srid")), a.field("dim").to_pylist(), a.field("kind").to_pylist(), parts.is_valid().to_pylist(), at, at[1:], strict=False)
    return [{"srid": n, "dim": d, "kind": k, "parts": one[i:j] if full else None} if there else None for there, n, d, k, full, i, j in rows]


def _parser(read):
    def parse(v):
        if v is None:
            return None
        try:
            return as_struct(read(v))
        except ValueError:
            return None

    def column(a: pa.Array) -> pa.Array:
        return pa.array([parse(v) for v in a.to_pylist()], ARROW)

    return lambda c: F.arrow_udf(column, GEOM)(c)  # a UDF needs a session


def _writer(write, kind: str):
    def column(a: pa.Array) -> pa.Array:
        return pa.array([None if s is None else write(of_struct(s)) for s in structs(a)], pa.string() if kind == "string" else pa.binary())

    return lambda c: F.arrow_udf(column, kind)(c)


#: Parsers give null for what they can't read, writers for null.
st_from_wkt, st_from_wkb, st_from_geojson = _parser(from_wkt), _parser(from_wkb), _parser(from_geojson)
st_as_wkt, st_as_ewkt = _writer(to_wkt, "string"), _writer(lambda g: to_wkt(g, True), "string")
st_as_wkb, st_as_ewkb = _writer(to_wkb, "binary"), _writer(lambda g: to_wkb(g, True, True), "binary")
st_as_geojson, st_as_kml, st_as_gml, st_as_svg = (_writer(w, "string") for w in (to_geojson, to_kml, to_gml, to_svg))


def number_text(v: Column) -> Column:
    """A double as text: whole numbers without a fraction."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), number_text(x), F.lit(" "), number_text(y), F.lit(")"))


def line_wkt(path: Column) -> Column:
    pair = lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))
    return F.when(F.size(path) > 0, F.concat(F.lit("LINESTRING("), F.array_join(F.transform(path, pair), ", "), F.lit(")"))).otherwise("LINESTRING EMPTY")


def point_geojson(x: Column, y: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), number_text(x), F.lit(","), number_text(y), F.lit("]}"))
