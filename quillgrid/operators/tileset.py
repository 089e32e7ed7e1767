"""Tiles that are stored in files: which to draw, loading those that are missing, and how many stay loaded.

The tiles are a DataFrame, however many; only what is loaded, a bounded number of blocks, is known to the driver. A loaded tile
is a lazy block: loading opens its file, and its rows are read where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import container
from ..store import Block
from . import tiles

SCHEMA = "id long, path string, level int, t double, minx double, miny double, maxx double, maxy double"


class TileSet:
    """Registered tiles, and the blocks of those that are loaded.

    load: path -> block, by default that of a container at the path. background: `draw` does not wait for missing tiles but has a
    thread load them; `wait` does. A tile that can't be loaded stays missing, and its error is in `failed`, by path.
    """

    def __init__(self, spark: SparkSession, registered: DataFrame | None = None, load: Callable[[str], Block] | None = None, background: bool = False):
        self.spark = spark
        self.tiles = spark.createDataFrame([], SCHEMA) if registered is None else registered.select([f.split()[0] for f in SCHEMA.split(", ")])
        self.loader = load or (lambda path: container.load(spark, path))
        self.loaded: dict[int, Block] = {}
        self.failed: dict[str, Exception] = {}
        self._used: dict[int, int] = {}
        self._frame = 0
        self._pool = ThreadPoolExecutor(1) if background else None
        self._waiting: dict[int, Future] = {}

    def register(self, ident: int, path: str, level: int, t: float, box: tuple[float, float, float, float]) -> None:
        """Add a tile; many at once are better given as a DataFrame."""
        row = self.spark.createDataFrame([(ident, path, level, float(t), *map(float, box))], SCHEMA)
        self.tiles = self.tiles.unionByName(row)

    def _load(self, ident: int, path: str) -> None:
        try:
            self.loaded[ident] = self.loader(path)
            self.failed.pop(path, None)
        except Exception as x:  # noqa: BLE001  a bad file must not stop the others; the caller sees why
            self.failed[path] = x

    def draw(self, max_level: int, box: tuple[float, float, float, float]) -> list[tuple[int, str, Block | None]]:
        """The tiles to draw for a window, coarse to fine: id, path, and the block where it is loaded.

        What to draw goes by what is loaded beforehand: a missing tile covers nothing, so coarser ones come with it.
        """
        self._collect()
        self._frame += 1
        here = self.spark.createDataFrame([(i, True) for i in self.loaded], "id long, loaded boolean")  # as many as are kept loaded
        known = self.tiles.join(F.broadcast(here), "id", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))
        window = self.spark.createDataFrame([(0, max_level, *map(float, box))], "window_id int, max_level int, minx double, miny double, maxx double, maxy double")
        taken = tiles.take(known, window).join(self.tiles.select("id", "path"), "id").orderBy("draw_order").select("id", "path").collect()  # one window's tiles
        for r in taken:
            self._used[r["id"]] = self._frame
            if r["id"] not in self.loaded and r["id"] not in self._waiting:
                if self._pool is None:
                    self._load(r["id"], r["path"])
                else:
                    self._waiting[r["id"]] = self._pool.submit(self._load, r["id"], r["path"])
        return [(r["id"], r["path"], self.loaded.get(r["id"])) for r in taken]

    def _collect(self) -> None:
        self._waiting = {i: f for i, f in self._waiting.items() if not f.done()}

    def wait(self) -> None:
        """Until all that is being loaded is there."""
        for f in list(self._waiting.values()):
            f.result()
        self._collect()

    def shrink(self, keep: int = 32) -> list[int]:
        """Close all loaded tiles but the `keep` that were drawn last; of one frame, those of the smaller ids stay. Their ids."""
        by_use = sorted(self.loaded, key=lambda i: (-self._used.get(i, 0), i))
        for i in by_use[keep:]:
            self.loaded.pop(i).close()
        return by_use[keep:]

    def close(self) -> None:
        if self._pool is not None:
            self._pool.shutdown()
        self.shrink(0)
