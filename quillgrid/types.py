"""Field types of layers, and schemas from annotated classes.

A layer's columns are never null: a missing value is its type's default. Quantised fields keep their range in the
column's metadata; references keep the name of the layer they point to.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import types as T

#: The row number of a feature within its layer. DataFrames have no order, so it is a column.
FID = "_fid"
REF_TYPE = T.StructType([T.StructField("ilayer", T.IntegerType()), T.StructField("ifeature", T.LongType())])


@dataclass(frozen=True)
class FieldType:
    code: int
    name: str
    size: int
    spark: T.DataType
    default: object


# Type codes and storage widths of the container format.
_TYPES = (
    FieldType(1, "u8", 1, T.ShortType(), 0),
    FieldType(2, "u16", 2, T.IntegerType(), 0),
    FieldType(3, "u32", 4, T.LongType(), 0),
    FieldType(4, "i32", 4, T.IntegerType(), 0),
    FieldType(5, "u8n", 1, T.DoubleType(), 0.0),
    FieldType(6, "u16n", 2, T.DoubleType(), 0.0),
    FieldType(7, "f32", 4, T.FloatType(), 0.0),
    FieldType(8, "f64", 8, T.DoubleType(), 0.0),
    FieldType(9, "str", 2, T.StringType(), ""),
    FieldType(10, "wstr", 2, T.StringType(), ""),
    FieldType(11, "ref", 5, REF_TYPE, None),
    FieldType(12, "bytes", 0, T.BinaryType(), b""),
)
BY_NAME = {t.name: t for t in _TYPES}
BY_CODE = {t.code: t for t in _TYPES}


class Feature:
    """Base of schema classes: annotations name the fields, e.g. `x: "f64"`; another schema class makes a reference.

    Instances hold one row's values; what is not given has its type's default.
    """

    def __init__(self, **values: object):
        known = fields_of(type(self))
        for name in values:
            if name not in known:
                raise AttributeError(f"{type(self).__name__} has no field {name!r}")
        self.__dict__.update(values)

    def __getattr__(self, name: str) -> object:
        known = fields_of(type(self))
        if name not in known:
            raise AttributeError(f"{type(self).__name__} has no field {name!r}")
        kind = known[name]
        return kind() if isinstance(kind, type) else BY_NAME[kind].default


_cache: dict[type, dict[str, str | type[Feature]]] = {}


def fields_of(cls: type) -> dict[str, str | type[Feature]]:
    """Field name -> type name or referenced class, in order; names that begin with _ are no fields."""
    if cls not in _cache:
        hints: dict[str, object] = {}
        homes: dict[str, type] = {}
        for base in reversed(cls.__mro__):
            own = vars(base).get("__annotations__", {}) if base is not Feature and base is not object else {}
            hints |= own
            homes |= dict.fromkeys(own, base)
        out: dict[str, str | type[Feature]] = {}
        for name, kind in hints.items():
            if name.startswith("_"):
                continue
            if isinstance(kind, str) and kind.strip("\"'") in ("bool", *BY_NAME):
                kind = kind.strip("\"'")
            elif isinstance(kind, str):
                kind = vars(sys.modules[homes[name].__module__]).get(kind.strip("\"'"), kind)
            if isinstance(kind, type) and issubclass(kind, Feature):
                if kind is cls:
                    raise TypeError(f"{cls.__name__}.{name} refers to its own class")
            elif kind not in BY_NAME and kind != "bool":
                raise TypeError(f"{cls.__name__}.{name}: unknown type {kind!r}")
            out[name] = "u8" if kind == "bool" else kind
        _cache[cls] = out
    return _cache[cls]


def field(name: str, kind: str, vmin: float = 0.0, vmax: float = 1.0, ref: str | None = None) -> T.StructField:
    """A column of a layer; names that the container can't hold are refused here."""
    if len(name.encode()) > 15:
        raise ValueError(f"field name {name!r} is longer than 15 bytes")
    meta: dict[str, object] = {"ft": kind}
    if kind in ("u8n", "u16n"):
        if not vmax > vmin:
            raise ValueError(f"{name}: the range {vmin}..{vmax} is empty")
        meta |= {"vmin": float(vmin), "vmax": float(vmax)}
    if ref:
        meta["ref"] = ref
    return T.StructField(name, BY_NAME[kind].spark, False, meta)


def schema_of(cls: type[Feature]) -> T.StructType:
    """The Spark schema of a schema class, with the row number first."""
    out = [T.StructField(FID, T.LongType(), False)]
    for name, kind in fields_of(cls).items():
        out.append(field(name, "ref", ref=kind.__name__) if isinstance(kind, type) else field(name, kind))
    return T.StructType(out)


def byte_size(kind: str, wide_strings: bool = False) -> int:
    """Storage width in a container row; string fields hold ids of 2 or 4 bytes."""
    return 4 if wide_strings and kind in ("str", "wstr") else BY_NAME[kind].size
