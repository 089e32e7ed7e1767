"""Geometries as database blobs (plain and compressed), as FGF bytes, and from KML."""

from __future__ import annotations

import re
import struct
from xml.etree import ElementTree

from pyspark.sql import functions as F

from . import textgeom
from .textgeom import DIMS, KINDS, Geometry

# Fixed values of the blob format.
START, MBR_END, MEMBER, END = 0x00, 0x7C, 0x69, 0xFE
COMPRESSED = 1000000


def _members(g: Geometry) -> list[Geometry]:
    if g.kind == "GeometryCollection":
        return g.coords
    return [Geometry(g.kind.removeprefix("Multi"), c, g.dim, g.srid) for c in g.coords]


def _vertices(g: Geometry) -> list[list[float]]:
    if not g.coords:
        return []
    if g.kind == "Point":
        return [g.coords]
    if g.kind == "LineString":
        return g.coords
    if g.kind == "Polygon":
        return [c for r in g.coords for c in r]
    return [c for p in _members(g) for c in _vertices(p)]


def to_blob(g: Geometry, compressed: bool = False, little: bool = True) -> bytes:
    """The blob: SRID and box before a class code and the coordinates. Compressed, the vertices of lines and rings
    between the first and the last are 32-bit differences from the one before (a measure stays a double)."""
    e = "<" if little else ">"
    every = _vertices(g)
    if not every:
        raise ValueError("an empty geometry has no blob")
    n = struct.Struct(e + "I").pack
    row = lambda c: struct.pack(f"{e}{len(g.dim)}d", *c)

    def run(cs: list) -> bytes:
        if not compressed or len(cs) < 3:
            return n(len(cs)) + b"".join(map(row, cs))
        out, at, m = [row(cs[0])], list(cs[0]), g.dim.find("M")
        for c in cs[1:-1]:
            step = [v if i == m else v - w for i, (v, w) in enumerate(zip(c, at, strict=True))]
            packed = struct.pack(e + "".join("d" if i == m else "f" for i in range(len(step))), *step)
            back = struct.unpack(e + "".join("d" if i == m else "f" for i in range(len(step))), packed)
            at = [v if i == m else w + v for i, (v, w) in enumerate(zip(back, at, strict=True))]  # as a reader adds them up
            out.append(packed)
        return n(len(cs)) + b"".join(out) + row(cs[-1])

    def body(g: Geometry) -> bytes:
        code = KINDS.index(g.kind) + 1 + 1000 * DIMS.index(g.dim) + (COMPRESSED if compressed and g.kind in ("LineString", "Polygon") else 0)
        if g.kind == "Point":
            return n(code) + row(g.coords)
        if g.kind == "LineString":
            return n(code) + run(g.coords)
        if g.kind == "Polygon":
            return n(code) + n(len(g.coords)) + b"".join(map(run, g.coords))
        parts = _members(g)
        return n(code) + n(len(parts)) + b"".join(bytes([MEMBER]) + body(p) for p in parts)

    xs, ys = [c[0] for c in every], [c[1] for c in every]
    head = bytes([START, int(little)]) + struct.pack(e + "i4d", g.srid, min(xs), min(ys), max(xs), max(ys)) + bytes([MBR_END])
    return head + body(g) + bytes([END])


def blob_box(raw: bytes) -> tuple[float, float, float, float]:
    """The box in a blob's head, without reading the coordinates."""
    if len(raw) < 45 or raw[0] != START or raw[1] not in (0, 1) or raw[38] != MBR_END or raw[-1] != END:
        raise ValueError("not a geometry blob")
    return struct.unpack_from(("<" if raw[1] else ">") + "4d", raw, 6)


def from_blob(raw: bytes) -> Geometry:
    blob_box(raw)
    e = "<" if raw[1] else ">"
    (srid,) = struct.unpack_from(e + "i", raw, 2)

    def count(at: int) -> tuple[int, int]:
        (n,) = struct.unpack_from(e + "I", raw, at)
        if n > len(raw):
            raise ValueError("a count beyond the blob")
        return n, at + 4

    def read(at: int) -> tuple[Geometry, int]:
        (code,) = struct.unpack_from(e + "I", raw, at)
        small, code = divmod(code, COMPRESSED)
        d, k = divmod(code, 1000)
        if small > 1 or d > 3 or not 1 <= k <= 7:
            raise ValueError(f"unknown class {code}")
        kind, dim = KINDS[k - 1], DIMS[d]
        whole = struct.Struct(f"{e}{len(dim)}d")
        m = dim.find("M")
        step = struct.Struct(e + "".join("d" if i == m else "f" for i in range(len(dim))))
        at += 4

        def run(at: int) -> tuple[list, int]:
            n, at = count(at)
            out: list[list[float]] = []
            for i in range(n):
                if small and 0 < i < n - 1:
                    out.append([v if j == m else w + v for j, (v, w) in enumerate(zip(step.unpack_from(raw, at), out[-1], strict=True))])
                    at += step.size
                else:
                    out.append(list(whole.unpack_from(raw, at)))
                    at += whole.size
            return out, at

        if kind == "Point":
            return Geometry(kind, list(whole.unpack_from(raw, at)), dim, srid), at + whole.size
        if kind == "LineString":
            cs, at = run(at)
            return Geometry(kind, cs, dim, srid), at
        n, at = count(at)
        parts: list = []
        for _ in range(n):
            if kind == "Polygon":
                ring, at = run(at)
                parts.append(ring)
                continue
            if raw[at] != MEMBER:
                raise ValueError("a member's mark is missing")
            p, at = read(at + 1)
            parts.append(p if kind == "GeometryCollection" else p.coords)
        return Geometry(kind, parts, dim, srid), at

    try:
        g, at = read(39)
    except (struct.error, IndexError) as x:
        raise ValueError("the blob ends early") from x
    if at != len(raw) - 1:
        raise ValueError("bytes after the geometry")
    return g


def to_fgf(g: Geometry) -> bytes:
    """FGF: little-endian kind, dimension and ordinates; members of multi-geometries have heads of their own. No SRID."""
    n = struct.Struct("<i").pack
    row = lambda c: struct.pack(f"<{len(g.dim)}d", *c)
    line = lambda cs: n(len(cs)) + b"".join(map(row, cs))
    head = n(KINDS.index(g.kind) + 1)
    if g.kind in ("Point", "LineString", "Polygon"):
        head += n(DIMS.index(g.dim))
        if g.kind == "Point":
            return head + row(g.coords)
        return head + (line(g.coords) if g.kind == "LineString" else n(len(g.coords)) + b"".join(map(line, g.coords)))
    parts = _members(g)
    return head + n(len(parts)) + b"".join(map(to_fgf, parts))


def from_fgf(raw: bytes) -> Geometry:
    def number(at: int) -> tuple[int, int]:
        (v,) = struct.unpack_from("<i", raw, at)
        if not 0 <= v <= len(raw):
            raise ValueError("a number beyond the bytes")
        return v, at + 4

    def read(at: int) -> tuple[Geometry, int]:
        k, at = number(at)
        if not 1 <= k <= 7:
            raise ValueError(f"unknown kind {k}")
        kind = KINDS[k - 1]
        if k > 3:
            n, at = number(at)
            parts = []
            for _ in range(n):
                p, at = read(at)
                if kind != "GeometryCollection" and p.kind != kind.removeprefix("Multi"):
                    raise ValueError(f"{p.kind} in {kind}")
                parts.append(p)
            dim = parts[0].dim if parts else "XY"
            return Geometry(kind, parts if kind == "GeometryCollection" else [p.coords for p in parts], dim), at
        d, at = number(at)
        if d > 3:
            raise ValueError(f"unknown dimension {d}")
        dim = DIMS[d]
        whole = struct.Struct(f"<{len(dim)}d")

        def line(at: int) -> tuple[list, int]:
            n, at = number(at)
            return [list(whole.unpack_from(raw, at + i * whole.size)) for i in range(n)], at + n * whole.size

        if kind == "Point":
            return Geometry(kind, list(whole.unpack_from(raw, at)), dim), at + whole.size
        if kind == "LineString":
            cs, at = line(at)
            return Geometry(kind, cs, dim), at
        n, at = number(at)
        rings = []
        for _ in range(n):
            r, at = line(at)
            rings.append(r)
        return Geometry(kind, rings, dim), at

    try:
        g, at = read(0)
    except struct.error as x:
        raise ValueError("the bytes end early") from x
    if at != len(raw):
        raise ValueError("bytes after the geometry")
    return g


def from_kml(text: str) -> Geometry:
    """A KML geometry, or the first one inside a Placemark; coordinates with heights make it XYZ. SRID is 4326."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        raise ValueError("document types are not read")
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as x:
        raise ValueError("not XML") from x
    tag = lambda n: n.tag.rsplit("}", 1)[-1]

    def coords(node: ElementTree.Element) -> list[list[float]]:
        found = [c for c in node if tag(c) == "coordinates"]
        if len(found) != 1 or not (found[0].text or "").strip():
            raise ValueError(f"{tag(node)} has no coordinates")
        out = [[float(v) for v in re.sub(r"\s*,\s*", ",", c).split(",")] for c in re.sub(r"\s*,\s*", ",", found[0].text.strip()).split()]
        if len({len(c) for c in out}) != 1 or len(out[0]) not in (2, 3):
            raise ValueError("coordinates of several lengths")
        return out

    def ring(node: ElementTree.Element) -> list[list[float]]:
        found = [c for c in node if tag(c) == "LinearRing"]
        if len(found) != 1:
            raise ValueError("a boundary holds one ring")
        return coords(found[0])

    def read(node: ElementTree.Element) -> Geometry:
        name = tag(node)
        if name in ("Point", "LineString"):
            cs = coords(node)
            return Geometry(name, cs[0] if name == "Point" else cs, "XYZ" if len(cs[0]) == 3 else "XY", 4326)
        if name == "Polygon":
            rings = [ring(c) for want in ("outerBoundaryIs", "innerBoundaryIs") for c in node if tag(c) == want]
            if not rings or sum(tag(c) == "outerBoundaryIs" for c in node) != 1:
                raise ValueError("a polygon has one outer boundary")
            return Geometry(name, rings, "XYZ" if len(rings[0][0]) == 3 else "XY", 4326)
        if name == "MultiGeometry":
            parts = [read(c) for c in node if tag(c) in ("Point", "LineString", "Polygon", "MultiGeometry")]
            kinds = {p.kind for p in parts}
            dim = parts[0].dim if parts else "XY"
            if len(kinds) == 1 and kinds <= {"Point", "LineString", "Polygon"} and all(p.dim == dim for p in parts):
                return Geometry("Multi" + kinds.pop(), [p.coords for p in parts], dim, 4326)
            return Geometry("GeometryCollection", parts, dim, 4326)
        for c in node:
            if tag(c) in ("Point", "LineString", "Polygon", "MultiGeometry"):
                return read(c)
        raise ValueError("no geometry")

    return read(root)


def from_gml(text: str) -> Geometry:
    """A GML geometry, of version 2 (coordinates, coord) or 3 (pos, posList); the SRID is the number that srsName ends in."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        raise ValueError("document types are not read")
    try:
        root = ElementTree.fromstring(re.sub(r"<(/?)gml:", r"<\1", text))
    except ElementTree.ParseError as x:
        raise ValueError("not XML") from x
    tag = lambda n: n.tag.rsplit("}", 1)[-1]
    singles = {"Point": "Point", "LineString": "LineString", "Curve": "LineString", "Polygon": "Polygon", "Surface": "Polygon"}
    several = {"MultiPoint", "MultiLineString", "MultiCurve", "MultiPolygon", "MultiSurface", "MultiGeometry"}
    outer, inner = ("exterior", "outerBoundaryIs"), ("interior", "innerBoundaryIs")

    def size(node: ElementTree.Element, given: int) -> int:
        return int(node.get("srsDimension") or node.get("dimension") or given)

    def coords(node: ElementTree.Element, dim: int) -> list[list[float]]:
        out: list[list[float]] = []
        for c in node.iter():
            if tag(c) in ("pos", "posList"):
                n = size(c, size(node, dim))
                flat = [float(v) for v in (c.text or "").split()]
                n = len(flat) if tag(c) == "pos" else n
                if n not in (2, 3) or len(flat) % n:
                    raise ValueError(f"{tag(node)}: positions of another dimension")
                out += [flat[i : i + n] for i in range(0, len(flat), n)]
            elif tag(c) == "coordinates":
                cs, ts, point = c.get("cs", ","), c.get("ts", " "), c.get("decimal", ".")
                words = (c.text or "").split() if ts.isspace() else [w.strip() for w in (c.text or "").strip().split(ts)]
                out += [[float(v.replace(point, ".")) for v in w.split(cs)] for w in words if w]
            elif tag(c) == "coord":
                out.append([float(x.text) for x in c])
        if not out or len({len(c) for c in out}) != 1 or len(out[0]) not in (2, 3):
            raise ValueError(f"{tag(node)} has no coordinates, or some of several lengths")
        return out

    def read(node: ElementTree.Element, dim: int) -> Geometry:
        name, dim = tag(node), size(node, dim)
        if name in ("Point", "LineString", "Curve"):
            cs = coords(node, dim)
            if name == "Point" and len(cs) != 1:
                raise ValueError("a point has one position")
            return Geometry(singles[name], cs[0] if name == "Point" else cs, "XYZ" if len(cs[0]) == 3 else "XY")
        if name in ("Polygon", "Surface"):
            rings = [coords(c, dim) for want in (outer, inner) for c in node.iter() if tag(c) in want]
            if sum(tag(c) in outer for c in node.iter()) != 1:
                raise ValueError("a polygon has one outer boundary")
            return Geometry("Polygon", rings, "XYZ" if len(rings[0][0]) == 3 else "XY")
        parts = [read(c, dim) for member in node if tag(member).lower().endswith(("member", "members")) for c in member]
        kinds, every = {p.kind for p in parts}, parts[0].dim if parts else "XY"
        if any(p.dim != every for p in parts):
            raise ValueError("members of several dimensions")
        if len(kinds) == 1 and kinds <= {"Point", "LineString", "Polygon"}:
            return Geometry("Multi" + kinds.pop(), [p.coords for p in parts], every)
        return Geometry("GeometryCollection", parts, every)

    found = next((n for n in root.iter() if tag(n) in singles or tag(n) in several), None)
    if found is None:
        raise ValueError("no geometry")
    g = read(found, 2)
    number = re.search(r"(\d+)\s*$", found.get("srsName") or "")
    return Geometry(g.kind, g.coords, g.dim, int(number[1]) if number else 0)


st_from_blob, st_from_fgf, st_from_kml, st_from_gml = (textgeom._parser(f) for f in (from_blob, from_fgf, from_kml, from_gml))
st_as_blob, st_as_compressed_blob = textgeom._writer(to_blob, "binary"), textgeom._writer(lambda g: to_blob(g, True), "binary")
st_as_fgf = textgeom._writer(to_fgf, "binary")


def st_as_hex_wkb(c):
    return F.hex(textgeom.st_as_wkb(c))


def st_from_hex_wkb(c):
    """Plain or extended bytes in hexadecimal digits."""
    return textgeom.st_from_wkb(F.unhex(c))
