import pytest
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgrid.functions import textgeom as G
from quillgrid.sources import container, parts
from quillgrid.store import Block
from quillgrid.types import FID, field

EXTENT = (-10.0, 0.0, 30.0, 20.0)


def _layer(spark, columns, rows):
    schema = T.StructType([T.StructField(FID, T.LongType(), False), *columns])
    return spark.createDataFrame([(i, *r) for i, r in reversed(list(enumerate(rows)))], schema)


@pytest.mark.parametrize("small", [True, False])
def test_layers_are_written_and_read_in_runs(spark, tmp_path, monkeypatch, small):
    """No layer is collected in the driver, and what lies on the borders of runs stays whole and in order."""
    if small:
        for name, n in (("ROWS", 3), ("POINTS", 5), ("WORDS", 2), ("SLICE", 16), ("TEXTS", 0), ("FEW", 0)):
            monkeypatch.setattr(container, name, n)

    def refuse(self):
        raise AssertionError("a whole layer in the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    g = lambda text: G.as_struct(G.from_wkt(text))
    words = ["b", "a", "", "b", "ü" * 40, "a", "c", "b", "d", "e"]
    points = [(w, w[::-1], g(f"POINT({i} {i / 2})") if i != 4 else None, i, {"ilayer": 1, "ifeature": 70000 + i}) for i, w in enumerate(words)]
    areas = [(i * 0.5, g(f"POLYGON(({i} 0, 9 0, 9 9, {i} 0))") if i % 3 else None) for i in range(7)]
    raw = [(bytes(range(i * 5)),) for i in range(8)]
    block = Block.of(spark, {
        "points": _layer(spark, [field("s", "str"), field("w", "wstr"), parts.geom_field("g", "point", "cf64"), field("n", "u32"), field("r", "ref")], points),
        "areas": _layer(spark, [field("v", "f64"), parts.geom_field("g", "polygon", "cf64", EXTENT, True)], areas),
        "raw": _layer(spark, [field("b", "bytes")], raw),
        "none": _layer(spark, [field("s", "str"), parts.geom_field("g", "line")], []),
    })
    where = str(tmp_path / "c.db")
    container.save(block, where)
    content = (tmp_path / "c.db").read_bytes()
    h = container.headers(content)
    assert [x["count"] for x in h] == [10, 7, 8, 0] and h[-1]["end"] == len(content)
    assert container._texts(content[h[0]["strings"] + 4 : h[0]["wides"]], False) == list(dict.fromkeys(words))
    back = container.load(spark, where)
    rows = lambda n: [r.asDict(recursive=True) for r in back[n].df.orderBy(FID).collect()]
    assert [(r[FID], r["s"], r["w"], r["_geom"] and G.of_struct(r["_geom"]).coords, r["n"], r["r"]) for r in rows("points")] == [(i, s, w, p and G.of_struct(p).coords, n, r) for i, (s, w, p, n, r) in enumerate(points)]
    assert [(r["v"], r["_geom"]) for r in rows("areas")] == areas and (rows("areas")[1]["_box"] is None) == (areas[1][1] is None)
    assert [(bytes(r["_bytes"]),) for r in rows("raw")] == raw and rows("none") == []


def test_a_container_cut_short(spark, tmp_path):
    container.save(Block.of(spark, {"L": _layer(spark, [field("v", "f64")], [(float(i),) for i in range(9)])}), str(tmp_path / "c.db"))
    (tmp_path / "d.db").write_bytes((tmp_path / "c.db").read_bytes()[:-40])
    with pytest.raises(ValueError):
        container.load(spark, str(tmp_path / "d.db"))["L"].df.collect()
