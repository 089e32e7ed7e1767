import random

from quillgrid.operators import tiles


def plain_take(all_tiles, window):
    """Tile by tile over the unit cells of a window of whole numbers."""
    _, most, x0, y0, x1, y1 = window
    met = [t for t in all_tiles if t[1] <= most and t[3] < x1 and x0 < t[5] and t[4] < y1 and y0 < t[6]]
    met.sort(key=lambda t: (-t[1], -t[2], (t[5] - t[3]) * (t[6] - t[4]), t[0]))
    left, out = {(x, y) for x in range(x0, x1) for y in range(y0, y1)}, []
    for t in met:
        if not left:
            break
        own = {(x, y) for x, y in left if t[3] <= x < t[5] and t[4] <= y < t[6]}
        if own:
            out.append(t[0])
            if t[7]:
                left -= own
    return out[::-1]


def test_take_against_tile_by_tile(spark):
    rnd = random.Random(7)
    found = []
    for i in range(160):
        level = rnd.randrange(6)
        size = 2 ** (6 - level)
        x, y = rnd.randrange(-64, 64), rnd.randrange(-64, 64)
        found.append((i, level, float(rnd.randrange(3)), x, y, x + size, y + size, rnd.random() < 0.7))
    found += [(900, 0, 1.0, -(2**20), -(2**20), 2**20, 2**20, True), (901, 5, 9.0, 3, 3, 3, 9, True)]  # the world, and a tile without area
    windows = [(i, rnd.randrange(6), *(lambda x, y, w, h: (x, y, x + w, y + h))(rnd.randrange(-40, 40), rnd.randrange(-40, 40), rnd.randrange(1, 30), rnd.randrange(1, 30))) for i in range(40)]
    t = spark.createDataFrame([(*r[:3], *map(float, r[3:7]), r[7]) for r in found], "id long, level int, t double, minx double, miny double, maxx double, maxy double, loaded boolean")
    w = spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in windows], "window_id long, max_level int, minx double, miny double, maxx double, maxy double")
    got = {}
    for r in tiles.take(t, w).orderBy("window_id", "draw_order").collect():
        got.setdefault(r["window_id"], []).append(r["id"])
    assert got == {r[0]: plain_take(found, r) for r in windows if plain_take(found, r)}
    assert tiles.take(t.limit(0), w).count() == 0 and tiles.take(t, w.limit(0)).count() == 0


def test_tiles_are_loaded_drawn_and_evicted(spark, tmp_path):
    from pyspark.sql import types as T

    from quillgrid.operators.tileset import TileSet
    from quillgrid.sources import container
    from quillgrid.store import Block
    from quillgrid.types import FID, field

    schema = T.StructType([T.StructField(FID, T.LongType(), False), field("tile", "u32")])
    for i in range(5):
        container.save(Block.of(spark, {"L": spark.createDataFrame([(0, i)], schema)}), f"{tmp_path}/{i}.db")
    boxes = [(0, 0, 0, 8, 8), (1, 1, 0, 4, 4), (2, 1, 4, 8, 8), (3, 2, 0, 2, 2), (4, 2, 2, 4, 4)]
    rows = [(i, f"{tmp_path}/{i}.db", level, 0.0, float(x), float(x), float(m), float(n)) for i, level, x, m, n in boxes]
    found = TileSet(spark, spark.createDataFrame(rows, "id long, path string, level int, t double, minx double, miny double, maxx double, maxy double"))
    found.register(9, f"{tmp_path}/none.db", 2, 1.0, (0, 0, 1, 1))
    first = found.draw(2, (0, 0, 2, 2))
    assert [i for i, *_ in first] == [0, 1, 3, 9] and set(found.failed) == {f"{tmp_path}/none.db"}
    assert [b["L"][0]["tile"] for _, _, b in first if b is not None] == [0, 1, 3]
    assert [i for i, *_ in found.draw(2, (0, 0, 2, 2))] == [3, 9]  # 3 covers the window; 9 is before it, and still missing
    found.draw(2, (5, 5, 6, 6))
    assert sorted(found.loaded) == [0, 1, 2, 3] and found.shrink(2) == [3, 1] and sorted(found.loaded) == [0, 2]
    found.close()
    assert not found.loaded
    later = TileSet(spark, spark.createDataFrame(rows, found.tiles.schema), background=True)
    assert [b for *_, b in later.draw(1, (0, 0, 2, 2))] == [None, None]
    later.wait()
    assert [i for i, *_ in later.draw(1, (0, 0, 2, 2))] == [1] and sorted(later.loaded) == [0, 1]
    later.close()
