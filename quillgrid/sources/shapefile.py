"""ESRI Shapefiles and DBF tables: reading through Spark's binary source, and writing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.polygon import area
from ..functions.textgeom import GEOM, Geometry, as_struct, of_struct

# Fixed values of the format.
SHAPES = {1: "Point", 3: "MultiLineString", 5: "MultiPolygon", 8: "MultiPoint"}
CODES = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5, "MultiPoint": 8}


def read_shapes(raw: bytes) -> list[Geometry | None]:
    """The shapes of a .shp file in order; null shapes are None. Z and M shapes keep their x and y."""
    if len(raw) < 100 or struct.unpack_from(">i", raw, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    out: list[Geometry | None] = []
    at = 100
    while at + 12 <= len(raw):
        _, words = struct.unpack_from(">2i", raw, at)
        (code,) = struct.unpack_from("<i", raw, at + 8)
        body = at + 12
        code %= 10
        if code == 0:
            out.append(None)
        elif code == 1:
            out.append(Geometry("Point", list(struct.unpack_from("<2d", raw, body))))
        elif code == 8:
            (n,) = struct.unpack_from("<i", raw, body + 32)
            v = struct.unpack_from(f"<{2 * n}d", raw, body + 36)
            out.append(Geometry("MultiPoint", [list(v[i : i + 2]) for i in range(0, 2 * n, 2)]))
        elif code in (3, 5):
            parts, n = struct.unpack_from("<2i", raw, body + 32)
            first = [*struct.unpack_from(f"<{parts}i", raw, body + 40), n]
            v = struct.unpack_from(f"<{2 * n}d", raw, body + 40 + 4 * parts)
            lines = [[list(v[2 * i : 2 * i + 2]) for i in range(a, b)] for a, b in zip(first, first[1:], strict=False)]
            if code == 3:
                out.append(Geometry("LineString", lines[0]) if parts == 1 else Geometry("MultiLineString", lines))
            else:
                polygons: list[list] = []
                for r in lines:  # outer rings run clockwise, holes the other way, after their outer ring
                    if area([tuple(p) for p in r]) > 0 and polygons:
                        polygons[-1].append(r)
                    else:
                        polygons.append([r])
                out.append(Geometry("Polygon", polygons[0]) if len(polygons) == 1 else Geometry("MultiPolygon", polygons))
        else:
            raise ValueError(f"unknown shape {code}")
        at += 8 + 2 * words
    return out


def write_shapes(shapes: list[Geometry | None]) -> tuple[bytes, bytes]:
    """.shp and .shx bytes. All shapes are of one class; None is a null shape."""
    kinds = {CODES[g.kind] for g in shapes if g is not None}
    if len(kinds) > 1:
        raise ValueError("shapes of one file are of one class")
    code = kinds.pop() if kinds else 1
    records, index, box = [], [], [float("inf"), float("inf"), float("-inf"), float("-inf")]
    offset = 50
    for i, g in enumerate(shapes):
        if g is None or not g.coords:
            body = struct.pack("<i", 0)
        else:
            if code == 5:
                rings = [r for p in ([g.coords] if g.kind == "Polygon" else g.coords) for r in _wound(p)]
            else:
                rings = [[g.coords]] if code == 1 else [g.coords] if g.kind in ("LineString", "MultiPoint") else g.coords
            pts = [p for r in rings for p in r] if code != 1 else [g.coords]
            own = [min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)]
            box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
            flat = struct.pack(f"<{2 * len(pts)}d", *[v for p in pts for v in p[:2]])
            if code == 1:
                body = struct.pack("<i", 1) + flat
            elif code == 8:
                body = struct.pack("<i4di", 8, *own, len(pts)) + flat
            else:
                starts, n = [], 0
                for r in rings:
                    starts.append(n)
                    n += len(r)
                body = struct.pack("<i4d2i", code, *own, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + flat
        records.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        index.append(struct.pack(">2i", offset, len(body) // 2))
        offset += 4 + len(body) // 2
    if box[0] == float("inf"):
        box = [0.0] * 4
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i8d", 1000, code, *box, 0, 0, 0, 0)
    return head(offset) + b"".join(records), head(50 + 4 * len(index)) + b"".join(index)


def _wound(rings: list) -> list:
    """The outer ring clockwise, the holes counter-clockwise."""
    return [r if (area([tuple(p[:2]) for p in r]) < 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)]


def dbf_fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """Name, type letter, width and decimals of a table's fields."""
    if len(raw) < 33 or raw[0] & 7 != 3:
        raise ValueError("not a DBF table")
    out, at = [], 32
    while raw[at] != 0x0D:
        out.append((raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return out


def read_dbf(raw: bytes, charset: str = "utf-8") -> list[dict]:
    """A table's rows but deleted ones; values that can't be read are None."""
    fields = dbf_fields(raw)
    rows, head, width = struct.unpack_from("<IHH", raw, 4)
    out = []
    for i in range(rows):
        at = head + i * width
        if raw[at : at + 1] == b"*":
            continue
        at += 1
        row: dict[str, object] = {}
        for name, kind, size, decimals in fields:
            text = raw[at : at + size].decode(charset, "replace").strip(" \0")
            at += size
            try:
                row[name] = text if kind == "C" else (text.upper() in ("T", "Y") if text and text != "?" else None) if kind == "L" else None if not text else text if kind == "D" else float(text) if decimals or kind == "F" else int(text)
            except ValueError:
                row[name] = None
        out.append(row)
    return out


def write_dbf(schema: T.StructType, rows: list[dict], charset: str = "utf-8") -> bytes:
    fields = []
    for f in schema.fields:
        t = f.dataType
        kind, size, dec = ("N", 19, 0) if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else ("N", 24, 10) if isinstance(t, (T.FloatType, T.DoubleType)) else ("L", 1, 0) if isinstance(t, T.BooleanType) else ("C", 254, 0)
        fields.append((f.name, kind, size, dec))
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 70, 1, 1, len(rows), 33 + 32 * len(fields), width)
    described = b"".join(struct.pack("<11sc4xBB14x", n.encode("ascii", "replace")[:10], k.encode(), s, d) for n, k, s, d in fields)
    body = []
    for r in rows:
        line = b" "
        for name, kind, size, dec in fields:
            v = r.get(name)
            text = b"" if v is None else (b"T" if v else b"F") if kind == "L" else (f"{v:.{dec}f}" if dec else str(v)).encode() if kind == "N" else str(v).encode(charset)
            if kind == "C":
                text = text[:size].decode(charset, "ignore").encode(charset)
            line += text.rjust(size) if kind == "N" else text.ljust(size)
        body.append(line)
    return head + described + b"\r" + b"".join(body) + b"\x1a"


_DBF_TYPES = {"C": "string", "D": "string", "L": "boolean", "F": "double"}


def read_shapefile(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """All shapefiles at a path (or glob of .shp): file, row, geom and the DBF's columns. A file is read by one task;
    several files are read side by side."""
    stem = lambda d, name: d.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("file"), F.col("content").alias(name))
    shp = stem(spark.read.format("binaryFile").load(path), "shp")
    dbf = stem(spark.read.format("binaryFile").load(path.removesuffix(".shp") + ".dbf"), "dbf")
    both = shp.join(dbf, "file")
    first = both.select(F.expr("substring(dbf, 1, 65535)").alias("h")).first()
    if first is None:
        raise FileNotFoundError(path)
    columns = [(n, _DBF_TYPES.get(k, "double" if d else "long")) for n, k, _, d in dbf_fields(bytes(first["h"]))]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, s, d in zip(b["file"], b["shp"], b["dbf"], strict=True):
                shapes, rows = read_shapes(bytes(s)), read_dbf(bytes(d), charset)
                out = pd.DataFrame({"file": f, "row": range(len(shapes)), "geom": [None if g is None else as_struct(g) for g in shapes]})
                for n, _ in columns:
                    out[n] = pd.Series([r.get(n) for r in rows], dtype=object).reindex(range(len(shapes)))
                yield out

    return both.mapInPandas(decode, f"file string, row long, geom {GEOM}, " + ", ".join(f"`{n}` {t}" for n, t in columns) if columns else f"file string, row long, geom {GEOM}")


def shapefile_bytes(df: DataFrame, geom_col: str = "geom") -> dict[str, bytes]:
    """The files of a shapefile of df's rows; the format is a single file, so the rows pass through the driver."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    shp, shx = write_shapes([None if r[geom_col] is None else of_struct(r[geom_col]) for r in rows])
    rest = T.StructType([f for f in df.schema.fields if f.name != geom_col])
    return {"shp": shp, "shx": shx, "dbf": write_dbf(rest, rows)}
