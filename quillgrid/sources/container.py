"""The single-file container of layers: writing, and reading it as one DataFrame a layer.

Little-endian: a magic of 16 bytes and the number of layers; for each layer a header of 144 bytes, field descriptors of
56, then geometry bytes, the row table, and dictionaries of strings and of wide strings. Rows are encoded and decoded by
executors, in runs; the driver only copies their bytes between the container and the shared folder, so any store that
Spark reads will do and no container needs to fit in memory.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import shared_path
from ..store import Block, with_fid
from ..types import BY_CODE, BY_NAME, FID, field
from . import parts

# Fixed values of the format.
MAGIC = b"FASTVectorDB0.1\0"
HEADER = struct.Struct("<64sIHHH??4x4d4Q")
FIELD = struct.Struct("<16sH6x2d2Q")
GEOM_NONE, GEOM_ANY = 0xFFFF, 0
#: Rows and vertices of a run of rows, and texts of a run of texts, about.
ROWS, POINTS, WORDS = 20_000, 500_000, 100_000
#: Bytes of geometries in a slice, about; bytes of a dictionary that is sent with the code; texts that are broadcast.
SLICE, TEXTS, FEW = 1 << 23, 1 << 18, 5_000
assert HEADER.size == 144 and FIELD.size == 56


def _row_dtype(fields: list[tuple[str, str]], wide: bool) -> np.dtype:
    ids = "<u4" if wide else "<u2"
    kinds = {"u8": "u1", "u16": "<u2", "u32": "<u4", "i32": "<i4", "u8n": "u1", "u16n": "<u2", "f32": "<f4", "f64": "<f8", "str": ids, "wstr": ids, "ref": "V5"}
    return np.dtype([(n, kinds[k]) for n, k in fields])


def _points(g: Column, shape: str) -> Column:
    """How many vertices a geometry of the canonical column has, or how long another's bytes or text are."""
    return F.coalesce(F.aggregate(g["parts"], F.lit(0), lambda n, p: n + F.size(p["points"])) if shape else F.length(g), F.lit(0))


def _encoder(fields: list[tuple[str, str, float, float]], dtype: np.dtype, stored: dict | None, loose: bool, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a partition to two values: the bytes of their geometries and those of their part of the row table."""

    def geometries(found: list) -> bytes:
        if not stored:
            return b"".join(struct.pack("<I", len(x)) + bytes(x) for x in found)
        return b"".join(parts.pack(x, stored["shape"], stored["coord"], tuple(stored["extent"]), stored["aabbox"]) for x in found)

    def table(batch: pa.RecordBatch) -> bytes:
        out = np.zeros(batch.num_rows, dtype)
        at = 0
        for n, k, lo, hi in fields:
            v = batch.column(at).to_numpy(zero_copy_only=False)
            at += 1
            if k == "ref":
                places = np.zeros((len(out), 5), "u1")
                places[:, :2] = v.astype("<u2").reshape(-1, 1).view("u1")
                places[:, 2:] = batch.column(at).to_numpy(zero_copy_only=False).astype("<u4").reshape(-1, 1).view("u1").reshape(-1, 4)[:, :3]
                out[n] = places.reshape(-1).view("V5")
                at += 1
            elif k in ("u8n", "u16n"):
                out[n] = (((255 if k == "u8n" else 65535) * (v.astype(float) - lo) / (hi - lo)).astype(np.int64) & (255 if k == "u8n" else 65535)).astype(dtype[n])
            else:
                out[n] = v.astype(dtype[n])
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometry, rows = [], []
        for b in batches:
            if b.num_rows:
                rows.append(table(b))
                if b.num_columns == columns + 2:  # points, as two columns
                    xy = np.stack([b.column(columns + i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
                    geometry.append(parts.pack_points(xy, stored["coord"], tuple(stored["extent"])))
                elif stored or loose:
                    geometry.append(geometries(b.column(columns).to_pylist()))
        if rows:
            yield pa.RecordBatch.from_pydict({"section": ["geometry", "table"], "value": [b"".join(geometry), b"".join(rows)]}, _SECTIONS)

    return run


_SECTIONS = pa.schema([("section", pa.string()), ("value", pa.binary())])


def _chunks(df: DataFrame, order: str, n: int, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> str:
    """A folder with a subfolder a section, in which each partition of df, in order, has a file: its value and a line feed.
    Only Spark writes there, so any store will do."""
    where = shared_path(df.sparkSession, "chunks")
    rows = df.repartitionByRange(n, order).sortWithinPartitions(order).drop(order)
    rows.mapInArrow(encode, "section string, value binary").select("section", F.col("value").cast("string").alias("value")).write.partitionBy("section").text(where, compression="none")
    return where


class _Store:
    """Files of any store, by the driver's JVM: copied there by buffers, so that no file is ever in memory as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def child(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def copy(self, source: object, out: object, n: int) -> None:
        if self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, n) != n:
            raise ValueError("the file ends within a layer")

    def section(self, name: str) -> list[tuple[object, int]]:
        """The files of a section and the sizes of their values, in order."""
        if not self.fs.exists(self.child(f"section={name}")):
            return []
        found = [(f.getPath(), f.getLen() - 1) for f in self.fs.listStatus(self.child(f"section={name}")) if f.getPath().getName().startswith("part-") and f.getLen()]
        return sorted(found, key=lambda f: f[0].getName())

    def append(self, out: object, files: list[tuple[object, int]]) -> None:
        for path, n in files:
            source = self.fs.open(path)
            try:
                self.copy(source, out, n)
            finally:
                source.close()


def _words(df: DataFrame, names: list[str], kind: str) -> tuple[DataFrame, int, list[tuple[object, int]], _Store] | None:
    """The distinct texts of some columns numbered as they are met first, column by column; how many; and their bytes' files."""
    if not names:
        return None
    every = df.select(FID, F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.coalesce(F.col(n), F.lit("")).alias("word")) for i, n in enumerate(names)])).alias("w"))
    first = every.groupBy(F.col("w.word").alias("word")).agg(F.min(F.struct("w.at", FID)).alias("first"))
    words = with_fid(first, "first").select(F.col(FID).alias("id"), "word")
    n = words.count()
    code, end = ("utf-8", b"\0") if kind == "str" else ("utf-16-le", b"\0\0")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [w.encode(code) + end for b in batches for w in b.column(0).to_pylist()]:
            yield pa.RecordBatch.from_pydict({"section": ["words"], "value": [b"".join(found)]}, _SECTIONS)

    store = _Store(df.sparkSession, _chunks(words, "id", -(-n // WORDS) or 1, encode))
    return words, n, store.section("words"), store


def _write_layer(out: object, name: str, df: DataFrame) -> None:
    """Write a layer. It stores one column of geometries or bytes: bytes become the rows' raw geometry.

    Executors make the bytes of runs of rows and of texts; the driver copies them behind each other."""
    schema = df.schema
    every = [(f.name, f.metadata["ft"], f.metadata.get("vmin", 0.0), f.metadata.get("vmax", 0.0)) for f in schema.fields if f.name != FID]
    raw = [f for f in schema.fields if f.name != FID and f.metadata["ft"] in ("bytes", "geom")]
    if len(raw) > 1:
        raise ValueError("a layer stores one column of geometries or bytes")
    stored = raw[0].metadata if raw and raw[0].metadata["ft"] == "geom" else None
    fields = [f for f in every if f[1] not in ("bytes", "geom")]
    if len(name.encode()) > 63:
        raise ValueError(f"layer name {name!r} is longer than 63 bytes")
    words = {k: _words(df, [n for n, t, *_ in fields if t == k], k) for k in ("str", "wstr")}
    sizes = {k: w[1] if w else 0 for k, w in words.items()}
    wide = any(f.metadata.get("wide") for f in schema.fields) or max(sizes.values()) > 65535
    dtype = _row_dtype([(n, k) for n, k, *_ in fields], wide)

    rows, columns = df, []
    for i, (n, k, *_) in enumerate(fields):
        if k in words:
            ids = words[k][0].select(F.col("word").alias(f"_word{i}"), F.col("id").alias(f"_id{i}"))
            rows = rows.join(F.broadcast(ids) if sizes[k] <= FEW else ids, F.coalesce(F.col(n), F.lit("")) == F.col(f"_word{i}"))
            columns.append(F.col(f"_id{i}"))
        elif k == "ref":
            columns += [F.col(n)["ilayer"].alias(f"_layer{i}"), F.col(n)["ifeature"].alias(f"_feature{i}")]
        else:
            columns.append(F.col(n))
    geometry, given = [], bool(raw) and isinstance(raw[0].dataType, T.StructType)
    if raw:
        g = F.col(raw[0].name)
        geometry = [g]
        if stored and given and stored["shape"] == "point":
            fits = g["kind"].isin(*parts.KINDS["point"]) & (g["dim"] == "XY")
            p = F.get(F.get(g["parts"], F.lit(0))["points"], F.lit(0))
            geometry = [F.coalesce(F.when(fits, p[a]), F.lit(float("nan"))).alias(f"_{a}") for a in "xy"]
    weight = _points(F.col(raw[0].name), "given" if given else "") if raw else F.lit(0)
    count, points = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight.cast("long")), F.lit(0))).first()
    n = max(-(-count // ROWS), points // POINTS, 1)
    store = _Store(df.sparkSession, _chunks(rows.select(F.col(FID), *columns, *geometry), FID, n, _encoder(fields, dtype, stored, bool(raw), len(columns))))

    sections = store.section("geometry"), store.section("table")
    length = [sum(n for _, n in s) for s in sections]
    texts = {k: 4 + sum(n for _, n in w[2]) if w else 4 for k, w in words.items()}
    at = length[0], length[0] + length[1], length[0] + length[1] + texts["str"]
    total = HEADER.size + FIELD.size * len(fields) + at[2] + texts["wstr"]
    kind = parts.SHAPES[stored["shape"]] if stored else GEOM_ANY if raw else GEOM_NONE
    coord, boxed = (parts.COORDS[stored["coord"]], stored["aabbox"]) if stored else (1, False)
    extent = tuple(stored["extent"]) if stored else (-180.0, -90.0, 180.0, 90.0)
    out.write(bytearray(HEADER.pack(name.encode(), count, kind, len(fields), coord, boxed, wide, *extent, *at, total)))
    for f, k, lo, hi in fields:
        out.write(bytearray(FIELD.pack(f.encode(), BY_NAME[k].code, lo, hi, dtype[f].itemsize, dtype.fields[f][1])))
    for s in sections:
        store.append(out, s)
    for k, w in words.items():
        out.write(bytearray(struct.pack("<I", sizes[k])))
        if w:
            w[3].append(out, w[2])


def headers(raw: bytes) -> list[dict]:
    """Names, counts, fields and places of a container's layers; ValueError for what is no container."""
    return _headers(lambda at, n: raw[at : at + n])


def _headers(read: Callable[[int, int], bytes]) -> list[dict]:
    if read(0, 16) != MAGIC:
        raise ValueError("not a container")
    (n,) = struct.unpack("<I", read(16, 4))
    out, at = [], 20
    for _ in range(n):
        name, count, geom, fields, coord, aabb, wide, *rest = HEADER.unpack(read(at, HEADER.size))
        base = at + HEADER.size + FIELD.size * fields
        found = []
        for i in range(fields):
            fname, code, lo, hi, _, _ = FIELD.unpack(read(at + HEADER.size + FIELD.size * i, FIELD.size))
            found.append({"name": fname.split(b"\0")[0].decode(), "ft": BY_CODE[code].name, "vmin": lo, "vmax": hi})
        out.append({"name": name.split(b"\0")[0].decode(), "count": count, "geom": geom, "coord": coord, "aabbox": aabb, "wide": wide, "extent": rest[:4], "fields": found, "base": base, "table": base + rest[4], "strings": base + rest[5], "wides": base + rest[6], "end": at + rest[7]})
        at += rest[7]
    return out


def _texts(raw: bytes, wide: bool) -> list[str]:
    if not wide:
        return [w.decode() for w in raw.split(b"\0")[:-1]]
    ends = np.flatnonzero(np.frombuffer(raw, "<u2", len(raw) // 2) == 0) * 2
    return [raw[a:b].decode("utf-16-le") for a, b in zip([0, *(ends[:-1] + 2)], ends, strict=True)] if len(ends) else []


def _read_rows(raw: bytes, h: dict, first: int, count: int, texts: dict[str, list[str] | None]) -> pd.DataFrame:
    """Rows of a layer from a slice: their geometries, then their part of the row table. Where texts are None, their numbers."""
    dtype = _row_dtype([(f["name"], f["ft"]) for f in h["fields"]], h["wide"])
    rows = np.frombuffer(raw, dtype, count, len(raw) - count * dtype.itemsize) if h["fields"] else np.zeros(count, dtype)
    out: dict[str, object] = {FID: np.arange(first, first + count, dtype=np.int64)}
    for f in h["fields"]:
        v, k = rows[f["name"]], f["ft"]
        if k in texts:
            out[f["name"]] = v.astype(np.int64) if texts[k] is None else [texts[k][i] for i in v]
        elif k == "ref":
            out[f["name"]] = [{"ilayer": int.from_bytes(bytes(x)[:2], "little"), "ifeature": int.from_bytes(bytes(x)[2:], "little")} for x in v]
        elif k in ("u8n", "u16n"):
            out[f["name"]] = f["vmin"] + (f["vmax"] - f["vmin"]) * v.astype(float) / (255 if k == "u8n" else 65535)
        else:
            out[f["name"]] = v.astype({"u8": np.int16, "u16": np.int32, "u32": np.int64, "i32": np.int32, "f32": np.float32, "f64": np.float64}[k])
    if h["geom"] == GEOM_ANY:
        at, chunks = 0, []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", raw, at)
            chunks.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        out["_bytes"] = chunks
    elif stored := _geometry(h):
        at, found, boxes = 0, [], []
        for _ in range(count):
            g, box, at = parts.unpack(raw, at, stored["shape"], stored["coord"], tuple(stored["extent"]), stored["aabbox"])
            found.append(g)
            boxes.append(box)
        out["_geom"] = found
        if stored["aabbox"]:
            out["_box"] = boxes
    return pd.DataFrame(out)


def _geometry(h: dict) -> dict | None:
    """How a layer stores its geometries, as the metadata of their column; None where it holds none."""
    shape = {v: k for k, v in parts.SHAPES.items()}.get(h["geom"])
    coord = {v: k for k, v in parts.COORDS.items()}.get(h["coord"])
    return parts.geom_field("_geom", shape, coord, tuple(h["extent"]), h["aabbox"]).metadata if shape and coord else None


def layer_schema(h: dict) -> T.StructType:
    out = [T.StructField(FID, T.LongType(), False), *[field(f["name"], f["ft"], f["vmin"], f["vmax"] if f["vmax"] > f["vmin"] else f["vmin"] + 1) for f in h["fields"]]]
    if h["geom"] == GEOM_ANY:
        out.append(field("_bytes", "bytes"))
    elif stored := _geometry(h):
        out.append(T.StructField("_geom", parts.GEOM, True, stored))
        if stored["aabbox"]:
            out.append(T.StructField("_box", parts.BOX))
    return T.StructType(out)


class _Window:
    """Bytes of an open file by their place, read ahead by the megabyte."""

    def __init__(self, source: object, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.source.seek(min(at, self.size))
            self.at, self.held = at, bytes(self.source.readNBytes(max(n, 1 << 20)))
        return self.held[at - self.at : at - self.at + n]


def _slices(read: _Window, h: dict) -> Iterator[tuple[int, int, int, int]]:
    """First row, number of rows, and place and length of the geometries of a layer's slices."""
    stored, at = _geometry(h), h["base"]
    fixed = parts.BYTES[stored["coord"]] if stored and stored["shape"] == "point" else None if stored or h["geom"] == GEOM_ANY else 0
    if fixed is not None:
        for first in range(0, h["count"], ROWS):
            n = min(ROWS, h["count"] - first)
            yield first, n, at + first * fixed, n * fixed
        return
    first, begin = 0, at
    for i in range(h["count"]):
        if i - first >= ROWS or at - begin >= SLICE:
            yield first, i - first, begin, at - begin
            first, begin = i, at
        if stored:
            at += 8 * stored["aabbox"]
            (n,) = struct.unpack("<H", read(at, 2))
            at += 2
            for _ in range(n):
                at += 3 + struct.unpack("<H", read(at + 1, 2))[0] * parts.BYTES[stored["coord"]]
        else:
            at += 4 + struct.unpack("<I", read(at, 4))[0]
    if h["count"]:
        yield first, h["count"] - first, begin, at - begin


def _runs(read: _Window, at: int, end: int, wide: bool) -> Iterator[tuple[int, int, int, int]]:
    """First number, number, and place and length of runs of whole texts."""
    first, step = 0, 2 if wide else 1
    while at < end:
        size = SLICE
        while True:
            raw = np.frombuffer(read(at, min(size, end - at) // step * step), "<u2" if wide else "u1")
            ends = np.flatnonzero(raw == 0)
            if len(ends) or size >= end - at:
                break
            size *= 2  # a text longer than that
        if not len(ends):
            raise ValueError("a text without an end")
        yield first, len(ends), at, (int(ends[-1]) + 1) * step
        first, at = first + len(ends), at + (int(ends[-1]) + 1) * step


def load(spark: SparkSession, path: str) -> Block:
    """A container as a block. The driver cuts the file into slices of whole rows, which it copies but does not decode,
    and executors decode these side by side."""
    store = _Store(spark, path)
    if not store.fs.exists(store.path):
        raise FileNotFoundError(path)
    source = store.fs.open(store.path)
    try:
        read = _Window(source, store.fs.getFileStatus(store.path).getLen())
        return Block.of(spark, {h["name"]: _load_layer(spark, store, source, read, h) for h in _headers(read)})
    finally:
        source.close()


def _cut(spark: SparkSession, store: _Store, source: object, pieces: Iterator[tuple[int, int, list[tuple[int, int]]]]) -> DataFrame:
    """Places and lengths of the file as rows: first, n, content; one file and one partition each."""
    to = _Store(spark, shared_path(spark, "slices"))
    to.fs.mkdirs(to.path)
    count = 0
    for first, n, spans in pieces:
        out = to.fs.create(to.child(f"{first}-{n}"), True)
        try:
            for at, length in spans:
                source.seek(at)
                store.copy(source, out, length)
        finally:
            out.close()
        count += 1
    name = F.regexp_extract("path", r"(\d+)-(\d+)$", 1).cast("long"), F.regexp_extract("path", r"(\d+)-(\d+)$", 2).cast("int")
    files = spark.read.format("binaryFile").load(to.path.toString()).select(name[0].alias("first"), name[1].alias("n"), "content")
    return files.repartition(count) if count > 1 else files


def _load_layer(spark: SparkSession, store: _Store, source: object, read: _Window, h: dict) -> DataFrame:
    schema = layer_schema(h)
    width = _row_dtype([(f["name"], f["ft"]) for f in h["fields"]], h["wide"]).itemsize if h["fields"] else 0
    texts: dict[str, list[str] | None] = {"str": [], "wstr": []}
    words: dict[str, DataFrame] = {}
    for k, at, end in (("str", h["strings"], h["wides"]), ("wstr", h["wides"], h["end"])):
        if end - at - 4 <= TEXTS:
            texts[k] = _texts(read(at + 4, end - at - 4), k == "wstr")
            continue
        texts[k] = None

        def split(batches: Iterator[pd.DataFrame], wide: bool = k == "wstr") -> Iterator[pd.DataFrame]:
            for b in batches:
                for first, raw in zip(b["first"], b["content"], strict=True):
                    found = _texts(bytes(raw), wide)
                    yield pd.DataFrame({"id": np.arange(first, first + len(found)), "word": found})

        words[k] = _cut(spark, store, source, ((f, n, [(a, length)]) for f, n, a, length in _runs(read, at + 4, end, k == "wstr"))).mapInPandas(split, "id long, word string")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, n, raw in zip(b["first"], b["n"], b["content"], strict=True):
                yield _read_rows(bytes(raw), h, int(first), int(n), texts)

    rows = _cut(spark, store, source, ((f, n, [(a, length), (h["table"] + f * width, n * width)]) for f, n, a, length in _slices(read, h)))
    ids = T.StructType([T.StructField(f.name, T.LongType()) if f.metadata.get("ft") in words else f for f in schema.fields])
    df = rows.mapInPandas(decode, ids)
    for i, f in enumerate(schema.fields):
        if f.metadata.get("ft") in words:
            w = words[f.metadata["ft"]].select(F.col("id").alias(f"_id{i}"), F.col("word").alias(f"_word{i}"))
            df = df.join(w, F.col(f.name) == F.col(f"_id{i}"), "left")
    found = lambda i: F.coalesce(F.col(f"_word{i}"), F.raise_error(F.lit("a text's number beyond the dictionary")).cast("string"))
    return df.select(*[found(i).alias(f.name, metadata=f.metadata) if f.metadata.get("ft") in words else F.col(f.name) for i, f in enumerate(schema.fields)]) if words else df


def save(block: Block, path: str) -> None:
    """Write a block's container to any file system that Spark knows."""
    store = _Store(block.spark, path)
    layers = list(block.fix().layers.values())
    out = store.fs.create(store.path, True)
    try:
        out.write(bytearray(MAGIC + struct.pack("<I", len(layers))))
        for x in layers:
            _write_layer(out, x.name, x.df)
    finally:
        out.close()
