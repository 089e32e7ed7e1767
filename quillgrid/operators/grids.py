"""Regular grids over geometries: squares, triangles and hexagons of a side length, anchored at an origin.

Cells are numbered by column and row from the origin, so that grids of different rows of a table fit together and can
be joined by number. Candidates come from the bounds of each geometry by two explodes, never as one array of all cells;
those that don't meet the geometry are dropped where they arise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import collection, path

SHAPES = ("square", "triangle", "hexagon")
_SIN60 = math.sqrt(3) / 2


def meets(g: Column, cell: Column) -> Column:
    """Whether a convex ring (a path, its first point not repeated) and a geometry share a point, edges included."""
    sides = path.segments(cell, True)
    vertex = F.exists(collection.points_of(g), lambda p: path.point_in_ring(p["x"], p["y"], cell) != "Outside")
    lines = F.filter(g["parts"], lambda p: p["ptype"] > 1)
    cross = F.exists(lines, lambda p: F.exists(path.segments(p["points"]), lambda s: F.exists(sides, lambda c: path.segments_cross(s["a"], s["b"], c["a"], c["b"], True))))
    first = F.get(cell, F.lit(0))
    rings = F.filter(collection.parts_of(g, 3, 4), lambda p: path.point_in_ring(first["x"], first["y"], p["points"]) == "Inside")
    return vertex | cross | (F.size(rings) % 2 == 1)  # without crossings a cell lies whole inside or outside


def _span(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.ceil(low).cast("long") - 1, F.floor(high).cast("long")))


def cells(df: DataFrame, geom: str, size: float, shape: str = "square", origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Each row of df once for every cell that meets its geometry, with the columns cell_i, cell_j, cell_k and cell.

    cell_k is 0, or 1 for triangles that point down; cell is the cell's ring without a repeated point. Null and empty
    geometries have no cells. ValueError for a size that is not positive, an unknown shape or names that df has itself.
    """
    if not size > 0 or shape not in SHAPES:
        raise ValueError(f"no grid of {shape} cells of size {size}")
    if clash := {"cell_i", "cell_j", "cell_k", "cell"} & set(df.columns):
        raise ValueError(f"columns that the grid adds are there already: {sorted(clash)}")
    ox, oy = origin
    # steps between columns and rows, the reach of a cell, and the shift of odd rows
    dx, dy, wide, low, high, odd = {
        "square": (size, size, size, 0.0, size, 0.0),
        "triangle": (size, size * _SIN60, size * 1.5, 0.0, size * _SIN60, -size / 2),
        "hexagon": (size * 3, size * _SIN60, size * 2, -size * _SIN60, size * _SIN60, -size * 1.5),
    }[shape]
    box = collection.bounds(F.col(geom))
    found = df.withColumn("cell", box).where(F.col("cell.minx").isNotNull())
    found = found.withColumn("cell_j", _span((F.col("cell.miny") - oy - high) / dy, (F.col("cell.maxy") - oy - low) / dy))
    shift = F.when(F.pmod("cell_j", F.lit(2)) == 1, odd).otherwise(0.0)
    found = found.withColumn("cell_i", _span((F.col("cell.minx") - ox - shift - wide) / dx, (F.col("cell.maxx") - ox - shift) / dx))
    found = found.withColumn("cell_k", F.explode(F.array(F.lit(0), F.lit(1))) if shape == "triangle" else F.lit(0))
    x, y = F.col("cell_i") * dx + shift + ox, F.col("cell_j") * dy + oy
    h, at = size * _SIN60, lambda a, b: path.point(x + a * size, y + b)
    ring = {
        "square": lambda: F.array(at(0, 0.0), at(1, 0.0), at(1, size), at(0, size)),
        "triangle": lambda: F.when(F.col("cell_k") == 0, F.array(at(0, 0.0), at(1, 0.0), at(0.5, h))).otherwise(F.array(at(0.5, h), at(1, 0.0), at(1.5, h))),
        "hexagon": lambda: F.array(at(0, 0.0), at(0.5, -h), at(1.5, -h), at(2, 0.0), at(1.5, h), at(0.5, h)),
    }[shape]()
    found = found.withColumn("cell", ring).where(meets(F.col(geom), F.col("cell")))
    return found.select(*df.columns, "cell_i", "cell_j", "cell_k", "cell")


def as_geometry(cell: Column, mode: str = "polygon", srid: int = 0) -> Column:
    """A cell as a polygon, as its edges (lines of two points each) or as its corners (points)."""
    ring = F.transform(F.concat(cell, F.slice(cell, 1, 1)), lambda p: collection.vertex(p["x"], p["y"]))
    polygon = collection.whole("Polygon", F.array(collection.part(3, ring)), srid=srid)
    if mode == "polygon":
        return polygon
    if mode == "edges":
        return collection.dissolve_segments(polygon)
    if mode == "points":
        corners = F.transform(cell, lambda p: collection.part(1, F.array(collection.vertex(p["x"], p["y"]))))
        return collection.whole("MultiPoint", corners, srid=srid)
    raise ValueError(f"unknown mode {mode!r}")
