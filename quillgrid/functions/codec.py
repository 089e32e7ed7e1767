"""Codecs of numbers and coordinates, as column expressions.

Encoding truncates toward zero and wraps to the storage width; decoding spreads the codes evenly over the range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a unit range: 2^bits - 1.
UNITS = {"u8n": 255, "u16n": 65535, "tx16": 65535, "tx24": 16777215, "tx32": 4294967295}


def truncated(x: Column) -> Column:
    """Toward zero, as a long."""
    return x.cast("double").cast("long")


def wrapped(x: Column, bits: int) -> Column:
    """The low bits of a truncated number, unsigned."""
    return F.pmod(truncated(x), F.lit(1 << bits))


def signed32(x: Column) -> Column:
    low = wrapped(x, 32)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def encode(x: Column, kind: str, low: Column | float, high: Column | float) -> Column:
    """The code of x in low..high. Out-of-range values wrap for u8n and u16n and are clamped for coordinates."""
    low, high = F.lit(low), F.lit(high)
    code = truncated(F.lit(UNITS[kind]) * (x - low) / (high - low))
    if kind in ("u8n", "u16n"):
        return F.pmod(code, F.lit(UNITS[kind] + 1))
    return F.least(F.greatest(code, F.lit(0)), F.lit(UNITS[kind]))


def decode(code: Column, kind: str, low: Column | float, high: Column | float) -> Column:
    low, high = F.lit(low), F.lit(high)
    return low + (high - low) * code / F.lit(float(UNITS[kind]))


def round_trip(x: Column, kind: str, low: Column | float, high: Column | float) -> Column:
    return decode(encode(x, kind, low, high), kind, low, high)


def padded_box(minx: Column, miny: Column, maxx: Column, maxy: Column, extent: tuple[float, float, float, float]) -> Column:
    """A box grown by one quantum a side and quantised to 16 bits an edge, clamped to the extent."""
    x0, y0, x1, y1 = extent
    qx, qy = (x1 - x0) / 65535, (y1 - y0) / 65535
    return F.struct(
        encode(minx - qx, "tx16", x0, x1).alias("minx"), encode(miny - qy, "tx16", y0, y1).alias("miny"),
        encode(maxx + qx, "tx16", x0, x1).alias("maxx"), encode(maxy + qy, "tx16", y0, y1).alias("maxy"),
    )


def in_extent(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    return x.between(extent[0], extent[2]) & y.between(extent[1], extent[3])


def utf16_units(s: Column) -> Column:
    """Length of a string in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("int")
