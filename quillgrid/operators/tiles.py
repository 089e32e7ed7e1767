"""Multi-scale tile selection: which tiles to draw for a window, by coverage.

Tiles of the finest level come first, then newer, then smaller ones. In that order a tile is taken if it overlaps the
window and is not yet covered by the loaded tiles taken before it; the search ends once the window is covered. In
sets: a dropped loaded tile lies within the union of those before it, so that union is that of all loaded candidates before.
The plane is cut along all candidates' edges into cells. With m the least rank of the loaded candidates over a cell, a
tile is taken if a cell of it has no m below its rank, and no later than the largest m of the window's cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")


def _levels(d: DataFrame) -> DataFrame:
    """d with grid: the power of two that is no less than a box's sides, so that a box touches at most four cells of its own grid."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-9))
    return d.withColumn("grid", F.ceil(F.log2(side)).cast("int"))


def _cells(d: DataFrame, also: list[int]) -> DataFrame:
    """d by the cells that a box touches: those of its own grid, and of the coarser grids that the other side's boxes have."""
    coarser = F.filter(F.array(*map(F.lit, also)).cast("array<int>"), lambda g: g > F.col("grid"))
    on = d.withColumn("at", F.explode(F.concat(F.array("grid"), coarser)))
    cell = lambda e: F.floor(F.col(e) / F.pow(F.lit(2.0), "at"))
    return on.withColumn("gx", F.explode(F.sequence(cell("minx"), cell("maxx")))).withColumn("gy", F.explode(F.sequence(cell("miny"), cell("maxy"))))


def ranked(tiles: DataFrame, windows: DataFrame, precision: int = 2) -> DataFrame:
    """Candidates of each window in the order of choice, with their edges rounded and clipped to the window.

    tiles: id, level, t, box, loaded; windows: window_id, max_level, box. Tiles meet windows in the cells of the grid that
    fits the larger of the two, so that the join is one of equal keys and no box is cut into many, whatever its size. Tiles that
    rounding leaves without area are covered by definition and dropped.
    """
    t, w = _levels(tiles.select("id", "level", "t", *BOX, "loaded")), _levels(windows.select("window_id", "max_level", *BOX))
    grids = lambda d: sorted(r["grid"] for r in d.select("grid").distinct().collect())  # noqa: E731  one row a power of two
    placed = _cells(w, grids(t)).withColumnsRenamed({c: f"w_{c}" for c in (*BOX, "grid")})
    both = _cells(t, grids(w)).join(placed, ["at", "gx", "gy"]).where(F.col("at") == F.greatest("grid", "w_grid"))
    hit = (F.col("minx") < F.col("w_maxx")) & (F.col("w_minx") < F.col("maxx")) & (F.col("miny") < F.col("w_maxy")) & (F.col("w_miny") < F.col("maxy"))
    # A pair meets in several cells; it counts in the first.
    size = F.pow(F.lit(2.0), "at")
    once = (F.col("gx") == F.floor(F.greatest("minx", "w_minx") / size)) & (F.col("gy") == F.floor(F.greatest("miny", "w_miny") / size))
    c = both.where(hit & once & (F.col("level") <= F.col("max_level")))
    order = W.partitionBy("window_id").orderBy(F.desc("level"), F.desc("t"), ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).asc(), "id")
    r = lambda lo, wlo, pick: F.round(pick(lo, wlo), precision)
    c = c.withColumn("rank", F.row_number().over(order)).select(
        "window_id", "id", "level", "rank", "loaded",
        r("minx", "w_minx", F.greatest).alias("minx"), r("miny", "w_miny", F.greatest).alias("miny"), r("maxx", "w_maxx", F.least).alias("maxx"), r("maxy", "w_maxy", F.least).alias("maxy"),
        *[F.round(f"w_{e}", precision).alias(f"w_{e}") for e in BOX],
    )
    return c.where((F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))


def _stretches(edges: DataFrame, axis: str) -> DataFrame:
    """Neighbouring edges of a window along one axis, as lo and hi, numbered from 1."""
    by = W.partitionBy("window_id").orderBy("e")
    cut = edges.distinct().select("window_id", F.col("e").alias(f"{axis}0"), F.lead("e").over(by).alias(f"{axis}1"), F.row_number().over(by).alias(f"{axis}n"))
    return cut.where(F.col(f"{axis}1").isNotNull())


def take(tiles: DataFrame, windows: DataFrame, precision: int = 2) -> DataFrame:
    """window_id, draw_order (coarse to fine, from 1), id, level of the tiles to draw for each window."""
    c = ranked(tiles, windows, precision)
    # Behind a loaded tile that covers the whole window nothing is taken.
    whole = F.col("loaded") & (F.col("minx") <= F.col("w_minx")) & (F.col("miny") <= F.col("w_miny")) & (F.col("maxx") >= F.col("w_maxx")) & (F.col("maxy") >= F.col("w_maxy"))
    last = F.min(F.when(whole, F.col("rank"))).over(W.partitionBy("window_id"))
    c = c.withColumn("last", last).where(F.col("last").isNull() | (F.col("rank") <= F.col("last")))
    edge = lambda *cs: c.select("window_id", F.explode(F.array(*cs)).alias("e"))
    xs, ys = _stretches(edge("minx", "maxx", "w_minx", "w_maxx"), "x"), _stretches(edge("miny", "maxy", "w_miny", "w_maxy"), "y")

    # The stretches that a candidate covers, by the numbers of its first and last one, and so the cells, only its own.
    def covers(d: DataFrame, at: DataFrame, axis: str) -> DataFrame:
        first = at.select("window_id", F.col(f"{axis}0").alias(f"min{axis}"), F.col(f"{axis}n").alias("n0"))
        final = at.select("window_id", F.col(f"{axis}1").alias(f"max{axis}"), F.col(f"{axis}n").alias("n1"))
        return d.join(first, ["window_id", f"min{axis}"]).join(final, ["window_id", f"max{axis}"]).withColumn(f"{axis}n", F.explode(F.sequence("n0", "n1"))).drop("n0", "n1")

    over = covers(covers(c.select("window_id", "rank", "loaded", *BOX), xs, "x"), ys, "y").select("window_id", "rank", "loaded", "xn", "yn")
    over = over.withColumn("m", F.min(F.when(F.col("loaded"), F.col("rank"))).over(W.partitionBy("window_id", "xn", "yn")))
    cells = xs.groupBy("window_id").agg(F.count("*").alias("nx")).join(ys.groupBy("window_id").agg(F.count("*").alias("ny")), "window_id")
    full = over.where(F.col("loaded") & (F.col("rank") == F.col("m"))).groupBy("window_id").agg(F.count("*").alias("n"), F.max("m").alias("most"))
    stop = full.join(cells, "window_id").where(F.col("n") == F.col("nx") * F.col("ny")).select("window_id", F.col("most").alias("stop"))
    open_ = over.where(F.col("m").isNull() | (F.col("m") >= F.col("rank"))).select("window_id", "rank").distinct()
    kept = open_.join(stop, "window_id", "left").where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop"))).join(c.select("window_id", "rank", "id", "level"), ["window_id", "rank"])
    place = W.partitionBy("window_id").orderBy(F.desc("rank"))
    return kept.select("window_id", F.row_number().over(place).alias("draw_order"), "id", "level")


def shrink(tiles: DataFrame, keep: int = 32) -> DataFrame:
    """The tiles to evict: all loaded ones but the `keep` that were used last. tiles: id, last_frame."""
    # Only the kept are sorted, in a bounded top-k; the rest is what an anti-join leaves.
    kept = tiles.orderBy(F.desc("last_frame"), "id").limit(keep).select("id")
    return tiles.join(F.broadcast(kept), "id", "left_anti")


def touch(tiles: DataFrame, taken: DataFrame, frame: int) -> DataFrame:
    """tiles with the frame stamped on those taken, and those loaded."""
    hit = taken.select("id").distinct().withColumn("_hit", F.lit(True))
    t = tiles.join(hit, "id", "left")
    return t.withColumn("last_frame", F.when(F.col("_hit"), F.lit(frame)).otherwise(F.col("last_frame"))).withColumn("loaded", F.col("loaded") | F.coalesce("_hit", F.lit(False))).drop("_hit")
